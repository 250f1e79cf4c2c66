"""Spark-native analytics on point observations and gridded rasters."""
