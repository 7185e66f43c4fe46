"""Relational analytics on Spark DataFrames."""
