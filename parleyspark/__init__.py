"""Spark-native operators for labelled short-text corpora and chat threads."""
