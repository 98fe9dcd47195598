"""A PySpark engine for document structure and translation data."""
