"""Spark-native analytics for tracing spills at sea to vessels."""
