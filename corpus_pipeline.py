"""The corpus pipeline: language, exact copies, near copies, mixture, token ids.

Every stage takes the documents that its predecessor kept, as a table with the columns of
``documents``; the last one returns the token digests of each document taken, once per copy.
Stages keep what their operators have written until the next stage has started, which is when
their result has been stored.

Null and empty texts have no language and are rejected by the first stage; rows that repeat a doc_id are judged
each by its own text, and of rows that repeat both one stays.  Rows with a null doc_id take part: they are
kept unless a row with an id has their text.  Very long texts stay whole.  An empty table gives no rows.  Columns beyond those of
``documents`` are dropped by the first stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lintlake.llm import bpe, exact_dedup, language, mixing, ngram_join
from lintlake.llm.common import new_path, release, written_so_far

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Whole texts travel to the Python workers in small batches, on both sides of the socket.  A stage's result is computed when
#: its caller writes it, so a stage called by itself leaves them set; ``run`` puts back what was there.
SETTINGS = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20), "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}
_mine: list[int] = [0, 0]


def _stage(work: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for name, value in SETTINGS.items():
            spark.conf.set(name, value)
        release(spark, *_mine)  # the stage before is stored
        _mine[0] = written_so_far()
        out = work(docs)
        _mine[1] = written_so_far()
        return out

    return run_stage


STAGES = [
    ("language", _stage(lambda docs: language.accepted(docs).select(*COLUMNS))),
    ("exact_dedup", _stage(lambda docs: exact_dedup.without_copies(docs).select(*COLUMNS))),
    ("near_dedup", _stage(lambda docs: ngram_join.one_of_each(docs).select(*COLUMNS))),
    ("mixture", _stage(lambda docs: mixing.mixed(docs).select(*COLUMNS))),
    ("tokens", _stage(lambda docs: bpe.digests(docs))),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again as the next one's input, the last one too."""
    before = {name: spark.conf.get(name, None) for name in SETTINGS}
    try:
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
        for name, stage in STAGES:
            out = stage(spark, docs, sf_dir)
            path = new_path(spark, f"stage-{name}")
            out.write.parquet(path)
            docs = spark.read.schema(out.schema).parquet(path)
            _mine[1] = written_so_far() - 1  # the stage's own tables go, its result stays
        return docs
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)
