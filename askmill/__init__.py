"""Evaluate language models over tables with Spark DataFrames."""

__version__ = "0.1.0"
