"""Spark-native index and analytics over crawled web pages and the entities found on them."""

__version__ = "0.1.0"
