"""Spark-native analytics for labelled, multi-channel sensor recordings."""
