"""Vexel: similarity search and hybrid retrieval over Spark DataFrames."""

__version__ = "0.1.0"
