"""Eigen-analysis of labelled, multi-dimensional data on Spark DataFrames."""

__version__ = "0.1.0"
