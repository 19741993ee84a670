"""Spark-native analytics over text corpora, pixels, regions and event logs."""
