"""Text of the query language to its syntax tree."""

from .parser import QueryError, parse

__all__ = ["QueryError", "parse"]
