"""Bulk product-label verification on Spark DataFrames."""
