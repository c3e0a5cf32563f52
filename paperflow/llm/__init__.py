"""Operators for preparing training data for language models, and the queries that apply them to whole tables."""

from .queries import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
