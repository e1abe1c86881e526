"""Spark-native disclosure analytics: span algebra over text, entity resolution, point-in-time views and productions."""
