"""Spark-native analytics over collections of linked Markdown notes and large text corpora."""
