"""Batch hybrid retrieval, its evaluation, and corpus operations on Spark DataFrames."""
