"""Spark-native analytics for typed-decision evaluation, see README.md."""
