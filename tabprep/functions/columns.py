"""Access to columns by exact name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(name: str) -> Column:
    """The column of this name, which may hold dots, dashes and backticks."""
    return F.col("`" + name.replace("`", "``") + "`")
