"""Inspection-quality analytics on Spark DataFrames."""
