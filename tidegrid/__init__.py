"""Spark-native analytics for irregular price trajectories and training-data preparation."""

__version__ = "0.1.0"
