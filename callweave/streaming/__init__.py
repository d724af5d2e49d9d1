"""Incremental refresh, in batch and as a stream of files."""
