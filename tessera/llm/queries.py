"""All queries of this subpackage and their reference SQL."""

from __future__ import annotations

from tessera.llm import backoff, conversations, cotraining, decontaminate, jaccard, licenses, packing, quality_rules, ranked_search, reference_sql, sharding, substring, token_counts, token_files  # noqa: F401  (each registers its query or its SQL)
from tessera.llm.common import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
