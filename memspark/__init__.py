"""memspark: a PySpark-native engine for long-term memory corpora."""

__version__ = "0.1.0"
