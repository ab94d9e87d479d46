"""tallywren: Spark-native ledger matching, evaluation and exception analytics."""

__version__ = "0.1.0"
