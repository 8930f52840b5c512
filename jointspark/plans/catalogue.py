"""Named queries over the driver's tables and their SQL counterparts."""

from __future__ import annotations

from . import allele_queries, annotation_queries, combine_queries, feature_queries, file_queries, genotype_queries, interval_queries, read_queries  # noqa: F401  they register themselves
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
