"""All queries of the library; importing a module registers its queries."""

from . import dataset_queries, page_queries, record_queries, run_queries, scalar_queries, shape_queries, step_queries  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
