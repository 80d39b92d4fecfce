"""Fitted cleanings and sessions over streams of files."""

from .clean import clean_files
from .sessions import Sessions, late_rows, session_files

__all__ = ["Sessions", "clean_files", "late_rows", "session_files"]
