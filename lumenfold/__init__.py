"""Spectral graph embedding analytics on Spark DataFrames."""
