"""Spark-native analytics for ranking candidates from many noisy scorers."""

__version__ = "0.1.0"
