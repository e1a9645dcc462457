"""Cellgrove: adaptive k-dimensional trees, meshes and field operators on Spark DataFrames."""

__version__ = "0.1.0"
