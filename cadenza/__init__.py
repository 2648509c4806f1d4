"""Cadenza: similarity, playlist and training-data analytics on Spark DataFrames."""
