"""Table schemas, readers, writers and intermediate tables."""
