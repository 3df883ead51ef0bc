"""logloom: a Spark-native analytics engine for LLM gateway call logs."""

__version__ = "0.1.0"
