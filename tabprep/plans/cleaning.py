"""Cleaning of a measured catalogue as an estimator: a few aggregates to fit, a lazy projection to apply."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.ml import Estimator, Model
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions.columns import quoted
from ..functions.measures import fill, leading_number, leading_unit
from ..operators.families import is_numeric, is_text
from ..sources.parquet import without_nan
from .profile import profile

#: Metadata columns, text measures and the guarded number of a food catalogue.
METADATA = ("url", "creator", "created_t", "created_datetime", "last_modified_t", "last_modified_datetime", "image_url", "image_small_url")
MEASURES = ("serving_size", "quantity")
NON_NEGATIVE = ("energy_100g",)


class CleanerModel(Model):
    """A fitted cleaning: which columns stay, what fills them, what is extracted and which rows are dropped.

    It is a list of expressions, so it applies to streams as well.
    """

    def __init__(self, kept: list[str], fills: dict[str, object], measures: tuple[str, ...], non_negative: tuple[str, ...], any_digits: bool):
        super().__init__()
        self.kept, self.fills, self.measures, self.non_negative, self.any_digits = kept, fills, measures, non_negative, any_digits

    def _transform(self, dataset: DataFrame) -> DataFrame:
        dataset = without_nan(dataset)
        filled = {c: fill(quoted(c), self.fills[c]) if c in self.fills else quoted(c) for c in self.kept}
        extracted = {}
        for name in self.measures:
            extracted[f"{name}_value"] = leading_number(filled[name], self.any_digits)
            extracted[f"{name}_unit"] = leading_unit(filled[name])
        columns = {**filled, **extracted}
        out = dataset.select(*[c.alias(n) for n, c in columns.items()])
        for name in self.measures:
            out = out.where(quoted(f"{name}_value") > 0)
        for name in self.non_negative:
            out = out.where(quoted(name) >= 0)
        return out


@dataclass
class Settings:
    drop: tuple[str, ...] = METADATA
    sparse: float = 0.5
    measures: tuple[str, ...] = MEASURES
    non_negative: tuple[str, ...] = NON_NEGATIVE
    required: frozenset[str] = field(default_factory=frozenset)
    exclude: frozenset[str] = field(default_factory=frozenset)
    any_digits: bool = False


class Cleaner(Estimator):
    """Fits a cleaning over the unfiltered rows: one aggregate, and counters for the text columns' most frequent values.

    In this order: drop metadata columns; drop columns whose part of missing cells
    is ``sparse`` or more (columns in ``required`` stay); fill numbers with their
    mean and text with its most frequent value (the smallest of equals), but for
    columns in ``exclude``; extract number and unit of the ``measures``; keep rows
    whose extracted numbers are above 0 and whose ``non_negative`` columns are 0 or
    more.  Filled cells count in the last steps.  NaN counts as missing throughout.

    Raises if a measure or guarded column is absent, too sparse, or of the wrong
    type.  Tables without rows or text columns are cleaned like any other.
    """

    def __init__(
        self,
        drop: Iterable[str] = METADATA,
        sparse: float = 0.5,
        measures: Iterable[str] = MEASURES,
        non_negative: Iterable[str] = NON_NEGATIVE,
        required: Iterable[str] = (),
        exclude: Iterable[str] = (),
        any_digits: bool = False,
    ):
        super().__init__()
        self.settings = Settings(tuple(drop), sparse, tuple(measures), tuple(non_negative), frozenset(required), frozenset(exclude), any_digits)

    def _fit(self, dataset: DataFrame) -> CleanerModel:
        s, dataset = self.settings, without_nan(dataset)
        names = [c for c in dataset.columns if c not in s.drop]
        known = profile(dataset, names, distinct=False)
        dense = [c for c in names if c in s.required or known.null_fraction(c) < s.sparse]
        for use, wanted, fits in (("measure", s.measures, is_text), ("guarded column", s.non_negative, is_numeric)):
            for c in wanted:
                if c not in dataset.columns:
                    raise ValueError(f"{use} {c!r} is not in the table")
                if c not in dense:
                    raise ValueError(f"{use} {c!r} is dropped, as {known.null_fraction(c):.0%} of it is missing" if c in names else f"{use} {c!r} is dropped as metadata")
                if not fits(known.columns[c].type):
                    raise TypeError(f"{use} {c!r} has type {known.columns[c].type.simpleString()}")
        fills = {}
        for c in dense:
            p = known.columns[c]
            value = p.mean if is_numeric(p.type) else p.mode if is_text(p.type) else None
            # a whole-number column without missing cells keeps its type; its mean would make it double
            whole = is_numeric(p.type) and not isinstance(p.type, (T.DoubleType, T.FloatType)) and p.non_null == known.rows
            if value is not None and c not in s.exclude and not whole:
                fills[c] = value
        return CleanerModel(dense, fills, s.measures, s.non_negative, s.any_digits)
