"""Movement analytics on Spark DataFrames: points, agents and tracks."""

from .model import Dataset, from_df, from_lines, read

__all__ = ["Dataset", "from_df", "from_lines", "read"]
