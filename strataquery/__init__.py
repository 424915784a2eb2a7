"""Spark-native document retrieval analytics: index build, search, incremental views, link graph."""
