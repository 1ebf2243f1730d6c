"""Spark-native engine for event streams, relationship graphs and training-data pipelines."""
