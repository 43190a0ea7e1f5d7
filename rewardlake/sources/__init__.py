"""Table loaders, derived views, file sources and sinks."""

from .fixtures import VIEWS, fixture, fixtures, oracle_with
from .tables import TABLES, register_tables, table

__all__ = ["VIEWS", "TABLES", "fixture", "fixtures", "oracle_with", "register_tables", "table"]
