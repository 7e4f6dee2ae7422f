"""Column and DataFrame helpers: windows, as-of joins, scalars."""
