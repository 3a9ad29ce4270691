"""corpusloom: full-text search, ranking and document processing on PySpark DataFrames."""

__version__ = "0.1.0"
