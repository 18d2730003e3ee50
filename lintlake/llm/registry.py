"""The registered queries of this package and their SQL.

Everything is imported here, so that a missing library shows where the package is first tried.
"""

from __future__ import annotations

import corpus_pipeline
from lintlake.llm import (
    bpe, chat, exact_dedup, language, merkle, minhash, mixing, ngram_join, quality, secrets, substring_dedup, topk, vector_codes,
)

MODULES = [ngram_join, language, secrets, exact_dedup, mixing, bpe, topk, chat, quality, substring_dedup, merkle, vector_codes, minhash]


def queries() -> dict:
    return {m.QUERY_NAME: m.query for m in MODULES} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {m.QUERY_NAME: m.SQL for m in MODULES if m.SQL is not None}
