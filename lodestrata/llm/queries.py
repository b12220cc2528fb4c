"""The queries of this subpackage and the SQL that some are checked against."""

from __future__ import annotations

import importlib

MODULES = ("warc", "token_counts", "resampling", "substring_dedup", "toxicity", "jaccard_join", "decontamination", "packing", "line_dedup", "quality", "target_resampling", "simhash", "filter_audit")


def queries() -> dict:
    return {k: f for m in MODULES for k, f in importlib.import_module(f"lodestrata.llm.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in importlib.import_module(f"lodestrata.llm.{m}").ORACLE_SQL.items()}
