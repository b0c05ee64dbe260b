"""itemloom: Spark jobs for large banks of text items."""
