"""affinium: content-similarity engine for item catalogs, built on PySpark."""

__version__ = "0.1.0"
