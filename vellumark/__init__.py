"""Document slicing, retrieval-text preparation and corpus work as Spark DataFrame operations."""

__version__ = "0.1.0"
