"""Column functions: surrogate keys, paths, encodings and ratios."""
