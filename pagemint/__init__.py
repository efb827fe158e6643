"""Grading of parsed documents and preparation of training text, on Spark DataFrames."""
