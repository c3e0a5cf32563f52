"""All queries of this subpackage."""

from . import queries_native, queries_ranked, queries_texts  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
