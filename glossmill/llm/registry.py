"""The registered queries of the corpus operators and their oracle SQL."""

from __future__ import annotations

from glossmill.llm import bpe, counts, infill, jaccard, media, packing, pii, quality, resample, secrets, sharding, substrings, toxicity

MODULES = [sharding, pii, jaccard, quality, substrings, secrets, bpe, counts, media, packing, resample, toxicity, infill]
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in MODULES for name, sql in module.SQL.items()}
