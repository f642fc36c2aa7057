"""Head-to-head event history on Spark DataFrames."""

__version__ = "0.1.0"
