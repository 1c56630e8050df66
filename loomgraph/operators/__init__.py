"""Operators on DataFrames of links, counts, graphs, distances and scores."""
