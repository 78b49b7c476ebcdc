"""quern: a Spark-native engine for document retrieval and corpus processing."""

__version__ = "0.1.0"
