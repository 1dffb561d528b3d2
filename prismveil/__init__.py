"""prismveil: a PySpark-native engine for text privacy and audit-log analytics."""

__version__ = "0.1.0"
