"""Registered queries and the SQL that states the same results, by family."""

from . import evaluation, files, more, tables  # noqa: F401
from .base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
