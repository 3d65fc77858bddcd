"""Spark-native research analytics on bar panels."""
