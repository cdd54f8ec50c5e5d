"""Sightline: Spark-native analytics for the data side of camera-pose estimation and 3D reconstruction."""

__version__ = "0.1.0"
