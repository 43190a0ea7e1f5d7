"""Named queries over the derived views; see ``registry``."""

from .registry import REGISTRY, Query, load_all, query

__all__ = ["REGISTRY", "Query", "load_all", "query"]
