"""Operators from DataFrames to DataFrames: pattern matching, traversal, resolution, queries and changes."""
