"""Plans of several steps: profile, cleaning, catalogue."""

from .catalogue import Catalogue
from .cleaning import Cleaner, CleanerModel
from .profile import ColumnProfile, TableProfile, profile

__all__ = ["Catalogue", "Cleaner", "CleanerModel", "ColumnProfile", "TableProfile", "profile"]
