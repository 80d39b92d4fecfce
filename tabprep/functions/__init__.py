"""Column expressions."""

from .columns import quoted
from .measures import fill, leading_number, leading_unit

__all__ = ["fill", "leading_number", "leading_unit", "quoted"]
