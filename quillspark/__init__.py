"""A PySpark engine that normalizes and analyses large collections of markdown documents."""
