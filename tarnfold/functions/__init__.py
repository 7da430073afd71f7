"""Column functions: text, paths, metadata, errors."""
