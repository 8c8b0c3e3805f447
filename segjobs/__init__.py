"""Spark jobs for the data side of raster segmentation, and for preparing text corpora."""
