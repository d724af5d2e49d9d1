"""callweave: code dependency graphs on Spark DataFrames, from source scan to traversal queries."""

__version__ = "0.1.0"
