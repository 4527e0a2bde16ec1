"""Operators: DataFrames in, DataFrames out, over many projects at once."""
