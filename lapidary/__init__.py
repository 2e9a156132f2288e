"""lapidary: a Spark-native engine that cuts raw tables into analysis-ready ones."""

__version__ = "0.1.0"
