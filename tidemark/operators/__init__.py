"""Domain operators: lazy DataFrames in, lazy DataFrames out."""
