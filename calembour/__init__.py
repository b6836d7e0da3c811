"""Spark-native analytics for bilingual wordplay and short-text corpora."""

__version__ = "0.1.0"
