"""Column functions: text, JSON, gzip and feature arrays."""
