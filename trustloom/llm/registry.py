"""Every query of this subpackage by name, with its SQL where SQL can express it."""

from __future__ import annotations

from trustloom.llm import (
    bpe,
    decontaminate,
    language,
    line_dedup,
    near_dedup,
    periodic_runs,
    quality,
    sharding,
    simhash,
    substring_dedup,
    token_alignment,
    topk,
    warc,
)

MODULES = (
    line_dedup, decontaminate, sharding, topk, warc, bpe, language, quality, substring_dedup, near_dedup,
    periodic_runs, token_alignment, simhash,
)

QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
