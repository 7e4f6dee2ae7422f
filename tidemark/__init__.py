"""Tidemark: point-in-time market research on Spark DataFrames."""
