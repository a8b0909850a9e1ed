"""The queries of this subpackage, and the SQL for those that SQL can express."""

from __future__ import annotations

from wirelake.llm import decontamination, exact_dedup, html_wrappers, jaccard_join, lm_scoring, mixing, pii, substring_dedup, token_counts, toxicity

MODULES = (pii, mixing, token_counts, jaccard_join, html_wrappers, exact_dedup, toxicity, lm_scoring, decontamination, substring_dedup)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in MODULES for name, sql in getattr(module, "SQL", {}).items()}
