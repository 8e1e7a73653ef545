"""Spatial count matrices and neighbourhood graphs as Spark DataFrames."""
