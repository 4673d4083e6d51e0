"""Spark-native analysis of court judgments and similar official documents."""
