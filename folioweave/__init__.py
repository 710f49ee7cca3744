"""Document-corpus analytics on Spark: documents in, relational tables and Markdown out."""

__version__ = "0.1.0"
