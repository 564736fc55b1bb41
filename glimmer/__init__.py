"""Spark-native analytics for imaging movies: frames, cells and traces as DataFrames."""
