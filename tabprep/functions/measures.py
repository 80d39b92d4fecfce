"""Numbers and units in free text such as ``100 g``."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

ASCII_NUMBER, ANY_NUMBER = r"([0-9]+\.?[0-9]*)", r"(?U)(\d+\.?\d*)"
UNIT = r"([a-zA-Z]+)"


def digit_map() -> tuple[str, str]:
    """All decimal digits beyond ASCII in the basic plane, and the ASCII digits that they stand for."""
    found = [chr(k) for k in range(128, 0x10000) if unicodedata.category(chr(k)) == "Nd"]
    return "".join(found), "".join(str(unicodedata.digit(c)) for c in found)


def leading_number(c: Column, any_digits: bool = False) -> Column:
    """The first number of a text as double, or NULL; signs and commas aren't part of it.

    ``any_digits`` also reads decimal digits of other scripts.
    """
    found = F.regexp_extract(c, ANY_NUMBER if any_digits else ASCII_NUMBER, 1)
    if any_digits:
        found = F.translate(found, *digit_map())
    return F.nullif(found, F.lit("")).try_cast("double")


def leading_unit(c: Column) -> Column:
    """The first run of ASCII letters of a text, or an empty text."""
    return fill(F.regexp_extract(c, UNIT, 1), "")


def fill(c: Column, value: object) -> Column:
    """``value`` where the column is missing."""
    return F.coalesce(c, F.lit(value))
