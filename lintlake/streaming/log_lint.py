"""Lint statements as they arrive.

Extraction, normalising and the rules are column expressions without state, so the batch
functions run unchanged on ``readStream`` frames; there is no watermark and nothing to
recover but the source offsets.  Totals are a batch job over the written issues.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lintlake.functions import text as tx
from lintlake.operators.rules import RuleSet, evaluate


def lint_stream(log: DataFrame, sql_col: str, id_col: str, rules: RuleSet | None = None) -> DataFrame:
    """Issues of each arriving statement, in long form."""
    rows = log.where(tx.looks_like_sql(F.col(sql_col))).select(
        F.col(id_col).alias("stmt_id"), F.col(sql_col).alias("original_sql"), tx.normalize(F.col(sql_col)).alias("norm"))
    return evaluate(rows, rules)


def write_issues(issues: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append issues to a Parquet folder, once per source row (file sink with its log)."""
    return (
        issues.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
