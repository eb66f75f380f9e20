"""Spark-native analytics for imagery catalogues, bathymetry grids and text corpora."""
