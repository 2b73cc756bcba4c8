"""Graphs, their documents and training data as Spark DataFrames."""
