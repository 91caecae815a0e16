"""threadlake: a PySpark-native engine for conversation and agent-session archives."""

__version__ = "0.1.0"
