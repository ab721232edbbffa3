"""Spark-native road telemetry analytics: batch DataFrames and Structured Streaming over one set of definitions."""
