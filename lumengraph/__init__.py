"""Spark-native analytics over linked note collections and text corpora."""
