"""Spark-native parallel map, map/reduce, chaining and text-object processing."""
