"""Vocabulary analytics on Spark DataFrames."""
