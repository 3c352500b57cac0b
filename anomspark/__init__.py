"""anomspark: Spark-native data profiling and anomaly scoring."""

__all__ = ["engine", "session"]
