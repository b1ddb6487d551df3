"""Bag-of-windows classification and evaluation on Spark DataFrames."""
