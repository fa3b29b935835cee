"""Brackwater: context-graph, vector, text and metrics analytics on Spark DataFrames."""
