"""Queries and SQL of this subpackage."""

from __future__ import annotations

from granary.llm import backoff, decontaminate, neighbours, packing, pii, quality, repeats, secrets, simhash, tokenfile

MODULES = [secrets, backoff, neighbours, repeats, packing, pii, simhash, decontaminate, tokenfile, quality]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: s for m in MODULES for k, s in m.ORACLE.items()}
