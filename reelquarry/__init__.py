"""Spark-native analytics for media catalogues, audiences and text corpora."""
