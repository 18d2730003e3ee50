"""Vector codes: vectors cut in parts, each part named by its nearest codebook entry.

Components become the integers ``floor(scale * x)``.  The codebook of each part starts as that part
of the vectors with the smallest ids; every round assigns all parts and moves each entry to the
floored mean of its parts.  Nearest entries are found with a tree of distance ranges (``gnat``), made
in each task from the codebooks: these are bounded by entries x dimensions and travel with the task.
Sums are made per task, merged by part and entry, and only the new codebooks reach the driver.

Vectors that are null or hold null or non-finite components are left out.  Shorter vectors are
filled up with zeros to the longest, and all to a multiple of the number of parts.  Integers are held to
+-2**26, so that squares and sums stay in 64 bits.  A null id ranks after all others; rows that repeat an id are
coded each, and of equal ids the smaller vector comes first among the starting entries.  With fewer
vectors than entries the codebooks are as short; an empty table has no codes.  Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.llm.common import table, written
from lintlake.llm.gnat import Gnat

QUERY_NAME = "op12_vector_codes"
PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
LIMIT = 1 << 26


def _whole(column: pa.Array, dims: int, scale: int) -> np.ndarray:
    """The integer vectors of a column of lists, filled up to ``dims``."""
    offs = column.offsets.to_numpy()
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = np.diff(offs)
    out = np.zeros((len(lengths), dims), np.int64)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    out[rows, np.arange(len(values)) - np.repeat(offs[:-1] - offs[0], lengths)] = np.clip(np.floor(scale * values), -LIMIT, LIMIT)
    return out


def _assigned(x: np.ndarray, trees: list[Gnat]) -> tuple[np.ndarray, np.ndarray]:
    """(rows, parts) arrays: the nearest entry of each part and the squared distance."""
    width = x.shape[1] // len(trees)
    found = [tree.nearest(np.ascontiguousarray(x[:, p * width:(p + 1) * width])) for p, tree in enumerate(trees)]
    return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def _trees(books: np.ndarray) -> list[Gnat]:
    return [Gnat(book) for book in books]


def _moved(vectors: DataFrame, books: np.ndarray, scale: int) -> np.ndarray:
    """One round: every entry becomes the floored mean of its parts; unused ones stay."""
    parts, entries, width = books.shape

    def sums(batches):
        trees = _trees(books)
        total, count = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            x = _whole(batch.column("v"), parts * width, scale)
            if len(x) == 0:
                continue
            code, _ = _assigned(x, trees)
            for p in range(parts):
                np.add.at(total[p], code[:, p], x[:, p * width:(p + 1) * width])
                count[p] += np.bincount(code[:, p], minlength=entries)
        part, entry = np.nonzero(count)
        yield pa.RecordBatch.from_pydict({
            "part": pa.array(part, pa.int64()), "entry": pa.array(entry, pa.int64()), "n": pa.array(count[part, entry], pa.int64()),
            **{f"s{k}": pa.array(total[part, entry, k], pa.int64()) for k in range(width)}})

    columns = [f"s{k}" for k in range(width)]
    schema = ", ".join(f"{c} long" for c in ["part", "entry", "n", *columns])
    merged = vectors.select("v").mapInArrow(sums, schema).groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in ["n", *columns]])
    out = books.copy()
    for row in merged.collect():  # at most parts x entries rows
        out[row["part"], row["entry"]] = [row[c] // row["n"] for c in columns]
    return out


def finite(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, label, v) of the rows whose vector is whole."""
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(embedding).cast("array<double>").alias("v")).where(
        F.col("v").isNotNull() & whole)


def trained(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> np.ndarray:
    """Codebooks (part, entry, position) of ``vectors`` (vec_id, v); no entries for an empty table."""
    longest = vectors.agg(F.max(F.size("v"))).first()[0] or 0
    width = max(1, -(-longest // parts))
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").toArrow().column("v").combine_chunks()
    start = _whole(first, parts * width, scale)
    books = np.ascontiguousarray(start.reshape(len(start), parts, width).transpose(1, 0, 2))
    for _ in range(rounds if len(start) else 0):
        books = _moved(vectors, books, scale)
    return books


def encode(vectors: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, code, error): the entry of each part as a list of bytes, and the sum of the squared distances."""
    parts, _, width = books.shape

    def run(batches):
        trees = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            trees = trees or _trees(books)
            code, error = _assigned(_whole(batch.column("v"), parts * width, scale), trees)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array([c.tobytes() for c in code.astype(np.uint8)], pa.binary()), pa.array(error.sum(axis=1), pa.int64())],
                ["vec_id", "label", "code", "error"])

    kind = dict(vectors.dtypes)["label"]
    return vectors.select("vec_id", "label", "v").mapInArrow(run, f"vec_id long, label {kind}, code binary, error long")


def compressed(rows: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """The codes of ``rows`` with ``label_error``, the error over all vectors of the same label, and the codebooks."""
    vectors = finite(rows)
    books = trained(vectors)
    coded = written(encode(vectors, books), "codes")
    of_label = written(coded.groupBy(F.col("label").alias("its_label")).agg(F.sum("error").alias("label_error")), "label-errors")
    # two written tables: Spark splits a label that a large part of the input has
    return coded.join(of_label, F.col("label").eqNullSafe(F.col("its_label"))).drop("its_label"), books


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compressed(table(spark, sf_dir, "embeddings"))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return coded.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql_round(i: int) -> str:
    return f"""
near{i} AS (SELECT s.vec_id, s.label, s.part, min(list_sum([(s.x[j] - b.y[j]) * (s.x[j] - b.y[j]) FOR j IN range(1, len(s.x) + 1)])::BIGINT * 64 + b.e) AS best FROM s JOIN book{i} b ON b.part = s.part GROUP BY ALL),
code{i} AS (SELECT vec_id, label, part, best % 64 AS e, best // 64 AS d FROM near{i})"""


def _sql_book(i: int) -> str:
    return f"""
mean{i} AS (SELECT c.part, c.e, j, floor(sum(s.x[j])::DOUBLE / count(*))::BIGINT AS m FROM code{i} c JOIN s ON s.vec_id = c.vec_id AND s.part = c.part, unnest(range(1, len(s.x) + 1)) u(j) GROUP BY ALL),
fresh{i} AS (SELECT part, e, list(m ORDER BY j) AS y FROM mean{i} GROUP BY part, e),
book{i + 1} AS (SELECT b.part, b.e, coalesce(f.y, b.y) AS y FROM book{i} b LEFT JOIN fresh{i} f ON f.part = b.part AND f.e = b.e)"""


SQL = f"""
WITH v AS (SELECT vec_id, label, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS c FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT vec_id, label, part, c[part * (len(c) // 16) + 1:(part + 1) * (len(c) // 16)] AS x FROM v, range(16) p(part)),
ids AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM v ORDER BY vec_id LIMIT 64),
book0 AS (SELECT s.part, ids.e, s.x AS y FROM s JOIN ids USING (vec_id)),
{_sql_round(0)}, {_sql_book(0)}, {_sql_round(1)}, {_sql_book(1)}, {_sql_round(2)},
coded AS (SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM code2 GROUP BY vec_id, label),
books AS (SELECT sha256(string_agg(y[j]::VARCHAR, ',' ORDER BY part, e, j)) AS codebooks_sha256 FROM book2, unnest(range(1, len(y) + 1)) u(j))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded, books
"""
