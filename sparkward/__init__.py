"""sparkward: Spark-native text-security analytics."""
__version__ = "0.2.0"
