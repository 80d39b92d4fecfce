"""Scans: delimited text with explicit rules for types, missing values and bad lines, and Parquet."""

from .delimited import NULL_TOKENS, read_delimited
from .lattice import read_delimited_files
from .parquet import read_parquet, read_split, without_nan
from .staging import staged

__all__ = ["NULL_TOKENS", "read_delimited", "read_delimited_files", "read_parquet", "read_split", "staged", "without_nan"]
