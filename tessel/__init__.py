"""tessel: a Spark-native engine for tabular, text, vector and chart analytics."""

__version__ = "0.1.0"
