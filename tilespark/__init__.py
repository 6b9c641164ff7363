"""Raster tile pyramids and training-data operators on Spark."""
