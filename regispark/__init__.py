"""regispark: a PySpark-native analytics engine for public document registries."""

__version__ = "0.1.0"
