"""tallyspark: a PySpark-native engine for multi-source catalogue analytics."""

__version__ = "0.1.0"
