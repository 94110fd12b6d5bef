"""A PySpark-native engine for scoring, evaluating and preparing large text collections."""

__version__ = "0.1.0"
