"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from panelspark.llm import bpe, decontam, langid, minhash, mixing, phrases, pii, pq, search, sharding, substring, suffix, toxicity

MODULES = (langid, bpe, toxicity, decontam, substring, suffix, sharding, pii, minhash, pq, phrases, mixing, search)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in getattr(m, "ORACLES", {}).items()}
