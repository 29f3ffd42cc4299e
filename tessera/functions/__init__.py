"""Column builders and scalar helpers."""
