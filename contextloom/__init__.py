"""contextloom: a PySpark-native engine for mining contexts in numeric data streams."""

__version__ = "0.1.0"
