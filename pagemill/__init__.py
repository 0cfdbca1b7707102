"""pagemill: a Spark-native engine for document-recognition tables."""

__version__ = "0.1.0"
