"""Ordered-sequence, segmentation and corpus operators for PySpark DataFrames."""
