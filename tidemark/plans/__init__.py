"""Plans over the driver tables: market-shaped views and one registered query per operator."""
