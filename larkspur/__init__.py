"""Array-flavoured analytics language and engine on PySpark DataFrames."""

__version__ = "0.1.0"
