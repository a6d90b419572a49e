"""All registered queries of the library and their SQL twins."""

from __future__ import annotations

from plumbline.plans import blend_queries, compare_queries, feature_queries, metric_queries, split_queries, table_queries  # noqa: F401
from plumbline.plans.book import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
