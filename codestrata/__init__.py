"""Code-graph analytics and training-data preparation on Spark DataFrames; `codestrata.api` has the public names."""

__version__ = "0.2.0"
