"""JSON-pattern queries over object graphs, compiled to Spark DataFrames."""

from .catalog import Catalog, Entity
from .engine import explain, query, query_json
from .sources.stores import open_store

__all__ = ["Catalog", "Entity", "explain", "open_store", "query", "query_json"]
