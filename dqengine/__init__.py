"""Data-quality profiling, repair, audit and monitoring on Spark DataFrames."""

__version__ = "0.1.0"
