"""Spark-native capture engine: URLs, pages, clips and model answers in, notes out."""
