"""Privacy-redaction analytics over text and page layouts, expressed as Spark DataFrames."""

__version__ = "0.1.0"
