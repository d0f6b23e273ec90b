"""A PySpark engine for hyperlinked document collections: link graphs, ranking and text similarity."""
