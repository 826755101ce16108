"""All queries over program facts: name -> callable, and name -> DuckDB SQL."""

from tidewater.plans import frame_queries, graph_queries, merge_queries, model_queries, program_queries, selection_queries, value_queries  # noqa: F401  (each registers its queries)
from tidewater.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
