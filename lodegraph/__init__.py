"""Spark-native analytics over documents and knowledge graphs."""
