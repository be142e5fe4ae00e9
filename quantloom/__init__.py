"""Quantitative-research analytics on Spark DataFrames."""
