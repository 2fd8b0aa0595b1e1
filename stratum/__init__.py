"""Spark-native surface, boundary and corpus analytics."""
