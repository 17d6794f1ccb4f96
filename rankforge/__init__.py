"""rankforge: hybrid retrieval, re-ranking and evaluation on PySpark DataFrames."""

__version__ = "0.1.0"
