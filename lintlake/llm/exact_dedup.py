"""Exact de-duplication with a persistent digest index.

The index is a Parquet table in the shared folder, bucketed and sorted by digest, one row for
each different text with the id of the document that stays.  New data is grouped by digest,
anti-joined with the index (sort-merge, the index side is not shuffled) and its new digests are
appended.  Whatever was indexed first stays, so data goes in from the largest ids down.

Texts are equal when they are the same after lower-casing A-Z only; null counts as empty.  Rows
with a null doc_id rank below all others: they stay only where no row with an id has their text.
Rows that repeat both doc_id and text are one document and are flagged alike.  Very long texts are
hashed whole; an empty table has no rows and adds none to the index.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lintlake.llm.common import new_path, table, written

QUERY_NAME = "op4_exact_dedup"
BATCHES = 2
#: Files of a bucket beyond which the index is written anew
MOST_FILES = 8
RULE = "sha256 of UTF-8 with A-Z lower-cased"
_ABOUT = "buckets int, rule string, generation int"
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


@F.arrow_udf(T.BinaryType())
def digest_of(text: pa.Array) -> pa.Array:
    """SHA-256 of the text with A-Z lower-cased."""
    return pa.array([hashlib.sha256((x.as_py() or b"").translate(_LOWER)).digest() for x in text], pa.binary())


class DigestIndex:
    """Digests seen so far: (digest, keep_id), bucketed and sorted by digest.

    The index keeps its number of buckets and the rule of its digests beside its files, and opening it
    again takes them from there, whatever the session's settings.  Every ingest adds a file to each bucket;
    beyond ``MOST_FILES`` the buckets are written anew, one sorted file each, as the next generation.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.path = path or new_path(spark, "digests")
        stored = self._stored()
        if stored and (stored["rule"] != RULE or buckets not in (None, stored["buckets"])):
            raise ValueError(f"the index at {self.path} has {stored['buckets']} buckets of {stored['rule']}, not {buckets} of {RULE}")
        self.buckets = stored["buckets"] if stored else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.generation = stored["generation"] if stored else 0
        if not stored:
            self._store()

    def _hadoop(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _stored(self) -> dict | None:
        """The newest complete description of the index, if there is one."""
        fs, p = self._hadoop(f"{self.path}/about")
        names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
        done = [int(n) for n in names if any(f.getPath().getName().startswith("part-") for f in fs.listStatus(self._hadoop(f"{self.path}/about/{n}")[1]))]
        return self.spark.read.schema(_ABOUT).json(f"{self.path}/about/{max(done)}").first().asDict() if done else None

    def _store(self) -> None:
        about = self.spark.range(1).select(F.lit(self.buckets).alias("buckets"), F.lit(RULE).alias("rule"), F.lit(self.generation).alias("generation"))
        about.coalesce(1).write.mode("overwrite").json(f"{self.path}/about/{self.generation}")

    def _files(self, generation: int) -> str:
        return f"{self.path}/files-{generation}"

    @contextmanager
    def _table(self, generation: int):
        """A name for the files of a generation; it leaves the catalogue, the files stay."""
        name = f"llm_digests_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {name} (digest BINARY, keep_id BIGINT) USING parquet "
                       f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self._files(generation)}'")
        try:
            yield name
        finally:
            self.spark.sql(f"DROP TABLE {name}")

    def rows(self) -> DataFrame:
        with self._table(self.generation) as name:
            return self.spark.table(name)

    def _append(self, rows: DataFrame, generation: int) -> None:
        with self._table(generation) as name:
            rows.repartition(self.buckets, "digest").write.insertInto(name)

    def ingest(self, batch: DataFrame) -> None:
        """Append the digests of ``batch`` (doc_id, digest) that are not known yet."""
        # written before the join, which would otherwise be moved below the grouping and see every copy
        groups = written(batch.groupBy("digest").agg(F.max("doc_id").alias("keep_id")), "batch")
        new = groups.join(self.rows().hint("merge"), "digest", "left_anti").select("digest", "keep_id")
        # a written table first: a plan must not read the table that it appends to
        self._append(written(new, "new-digests"), self.generation)
        fs, p = self._hadoop(self._files(self.generation))
        if sum(f.getPath().getName().endswith(".parquet") for f in fs.listStatus(p)) > MOST_FILES * self.buckets:
            self.compact()

    def compact(self) -> None:
        """One sorted file per bucket again; the old files go once the new ones are described."""
        old, self.generation = self.generation, self.generation + 1
        fs, p = self._hadoop(self._files(self.generation))
        fs.delete(p, True)  # of a run that ended before it was described
        with self._table(old) as name:
            # an expression hides the buckets of the old files, which would otherwise be taken for the wanted partitions
            self._append(self.spark.table(name).withColumn("digest", F.concat("digest", F.lit(b""))), self.generation)
        self._store()
        fs, p = self._hadoop(self._files(old))
        fs.delete(p, True)


def dedupe(docs: DataFrame, index: DigestIndex | None = None, batches: int = BATCHES) -> DataFrame:
    """(doc_id, digest, keep_id, group_size, kept) for every row of ``docs`` (doc_id, text).

    ``group_size`` counts the rows of ``docs`` with the same text; with a filled ``index``,
    texts known to it are not kept.
    """
    rows = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest_of(F.col("text").cast("binary")).alias("digest")), "rows")
    index = index or DigestIndex(docs.sparkSession)
    low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    low, high = low or 0, high or 0
    cuts = [high - (high - low + 1) * i // batches for i in range(1, batches)]
    for i in range(batches):
        part = rows if batches == 1 else rows.where(
            (F.col("doc_id") > cuts[0]) if i == 0 else
            ((F.col("doc_id") <= cuts[-1]) | F.col("doc_id").isNull()) if i == batches - 1 else
            ((F.col("doc_id") <= cuts[i - 1]) & (F.col("doc_id") > cuts[i])))
        index.ingest(part)
    sizes = rows.groupBy("digest").agg(F.count("*").alias("group_size"))
    groups = written(sizes.join(index.rows().hint("merge"), "digest").select("digest", "keep_id", "group_size"), "groups")
    # two written tables: Spark splits the rows of a text that a large part of the input shares
    return rows.join(groups, "digest").select("doc_id", "digest", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"))


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one of each text."""
    key = [F.coalesce("doc_id", F.lit(-1)).alias("__copy_id"), F.col("doc_id").isNull().alias("__copy_no_id"), F.col("digest").alias("__copy_digest")]
    kept = dedupe(docs).where("kept").select(*key).distinct()
    keyed = docs.withColumns({"__copy_id": F.coalesce("doc_id", F.lit(-1)), "__copy_no_id": F.col("doc_id").isNull(), "__copy_digest": digest_of(F.col("text").cast("binary"))})
    names = ["__copy_id", "__copy_no_id", "__copy_digest"]
    return keyed.join(kept, names, "left_semi").dropDuplicates(names).drop(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedupe(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""
