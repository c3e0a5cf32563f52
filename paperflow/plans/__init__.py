"""Named queries: each operator bound to a set of tables, next to the SQL that must give the same rows."""

from . import drafts, export, fields, files, layout, linkage, messages, review, scoring  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
