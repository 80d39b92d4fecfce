"""Column selection by type, name, role and cardinality, and narrowing of numbers."""

from .families import is_numeric, is_text, is_wide
from .roles import RoleReport, column_roles
from .selectors import (
    drop_columns,
    low_cardinality,
    n_unique,
    numeric_columns,
    pick,
    text_columns,
    text_except,
    text_except_dates,
    wide_numeric,
)
from .shrink import Narrowing, shrink, shrink_plan

__all__ = [
    "Narrowing", "RoleReport", "column_roles", "drop_columns", "is_numeric", "is_text", "is_wide", "low_cardinality",
    "n_unique", "numeric_columns", "pick", "shrink", "shrink_plan", "text_columns", "text_except", "text_except_dates", "wide_numeric",
]
