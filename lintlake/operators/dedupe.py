"""De-duplication of occurrences by fingerprint.

The statement row keeps the first occurrence and a count; the locations stay rows of
their own, because one fingerprint may hold a large share of all occurrences and must
never become one array.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.functions import text as tx


def with_fingerprint(occ: DataFrame) -> DataFrame:
    """Add the fingerprint text and ``stmt_key``, the hash that groups occurrences (case-insensitive)."""
    occ = occ.withColumn("abstract_sql", tx.abstract_sql(F.col("sql")))
    return occ.withColumn("stmt_key", tx.sql_hash(F.upper("abstract_sql")))


def keyed(occ: DataFrame) -> DataFrame:
    """Occurrences with ``stmt_key``; a frame that has it stays as it is.

    The fingerprint is the costly part: write ``keyed(occ)`` once (``ResultStore``) and give the stored
    frame to ``dedupe``, ``locations`` and ``dedup_stats``, which then make none of their own.
    """
    return occ if "stmt_key" in occ.columns else with_fingerprint(occ).drop("abstract_sql")


_ORDER = ["path", "line", "source_type", "sql"]


def first_and_count(occ: DataFrame) -> DataFrame:
    """(stmt_key, first, location_count): a state that merges, see ``merge_states``.

    Minimum and count combine in the map tasks, so a hot fingerprint sends one row per task.
    """
    extra = [c for c in ("occ_id",) if c in occ.columns]
    rows = keyed(occ).select("stmt_key", *_ORDER, *extra, "file_name")
    first = F.min(F.struct(*_ORDER, *extra, "file_name")).alias("first")
    return rows.groupBy("stmt_key").agg(first, F.count(F.lit(1)).alias("location_count"))


def merge_states(states: DataFrame) -> DataFrame:
    """One row per fingerprint from several states of it."""
    return states.groupBy("stmt_key").agg(F.min("first").alias("first"), F.sum("location_count").alias("location_count"))


def statements_of(state: DataFrame) -> DataFrame:
    """The statement rows of a state; the fingerprint text does not travel, it is made again from the kept text."""
    extra = [c for c in ("occ_id",) if c in state.select("first.*").columns]
    out = state.withColumn("abstract_sql", tx.abstract_sql(F.col("first.sql")))
    return out.select(
        tx.sql_id(F.col("abstract_sql")).alias("stmt_id"),
        "stmt_key",
        tx.sql_type(F.col("first.sql")).alias("sql_type"),
        F.col("first.sql").alias("original_sql"),
        "abstract_sql",
        F.col("first.source_type").alias("source_type"),
        F.col("first.path").alias("first_path"),
        F.col("first.file_name").alias("first_file"),
        F.col("first.line").alias("first_line"),
        *[F.col(f"first.{c}").alias(f"first_{c}") for c in extra],
        "location_count",
    )


def dedupe(occ: DataFrame) -> DataFrame:
    """DED-1: one row per fingerprint, first text by (path, line, source_type)."""
    return statements_of(first_and_count(occ))


def locations(occ: DataFrame) -> DataFrame:
    """Every place of every statement, keyed by ``stmt_key``; a narrow projection."""
    return keyed(occ).select("stmt_key", "path", "file_name", "line", "source_type")


def dedup_stats(occ: DataFrame) -> DataFrame:
    """DED-2: total, unique, duplicates, duplicate rate in percent (one decimal)."""
    return _stats(keyed(occ).groupBy("stmt_key").agg(F.count(F.lit(1)).alias("n")))


def _stats(per_key: DataFrame) -> DataFrame:
    out = per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("uniq")
    ).withColumn("duplicates", F.col("total") - F.col("uniq"))
    rate = F.floor(F.col("duplicates") * 1000.0 / F.col("total") + 0.5) / 10.0
    return out.withColumn("duplicate_rate", F.when(F.col("total") == 0, 0.0).otherwise(rate))


class FingerprintState:
    """Fingerprints of many scans: each ingest adds the state of its own occurrences, reading merges them.

    ``path`` is a folder that all executors share.  A batch is written under its name and replaced when it is
    ingested again, so a job that was lost half way is simply run again; a scan after changes ingests the changed
    files' occurrences only, one batch a file group.  A batch holds a fingerprint once, so merging shuffles
    batches x fingerprints rows and no occurrences; ``compacted`` writes the merged rows as one batch elsewhere.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def ingest(self, occ: DataFrame, batch: str) -> FingerprintState:
        first_and_count(occ).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        return self

    def state(self) -> DataFrame:
        return merge_states(self.spark.read.parquet(self.path))

    def statements(self) -> DataFrame:
        """DED-1 over all batches."""
        return statements_of(self.state())

    def stats(self) -> DataFrame:
        """DED-2 over all batches."""
        return _stats(self.state().select("stmt_key", F.col("location_count").alias("n")))

    def compacted(self, path: str) -> FingerprintState:
        """The same state as one batch under a new path; later ingests go there."""
        out = FingerprintState(self.spark, path)
        self.state().write.mode("overwrite").parquet(f"{out.path}/batch=base")
        return out


def merge_locations(a: DataFrame, b: DataFrame) -> DataFrame:
    """DED-3: union of two location frames; a (statement, file, line) is kept once."""
    return (
        a.unionByName(b)
        .groupBy("stmt_key", "path", "line")
        .agg(F.min(F.struct("file_name", "source_type")).alias("kept"))
        .select("stmt_key", "path", "line", "kept.file_name", "kept.source_type")
    )


def scan_counts(occ: DataFrame) -> DataFrame:
    """DED-4: statements found and statements kept."""
    return dedup_stats(occ).select(F.col("total").alias("sql_found"), F.col("uniq").alias("unique_sql"))
