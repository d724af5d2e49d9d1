"""Reading and writing: source trees, the Parquet graph, generated graphs."""
