"""Layered temporal graph, knowledge-graph and causal analytics on Spark DataFrames."""
