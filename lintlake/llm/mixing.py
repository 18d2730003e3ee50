"""Mixing sources to target weights by pivotal dependent rounding.

A source with ``target`` words asks each of its documents for ``target / source_size`` copies:
the whole part for all of them, and the fraction as a probability.  Documents of a cell (a
source, a class of sizes, a bounded block) are ordered by size and paired: mass moves at random
between two fractions until one is 0 or 1, which keeps the sum and so nearly the words.  The one
fraction left in a cell goes up a reduction tree: 256 blocks at a time, then the classes of the
source, until each source has one left, which is rounded by chance.  The random numbers are
hashes of the seed and the document, so reruns agree.

Sources by code point (null last) weigh 1, 2, 3, repeating.  The table of sources, one row
each, is ordered in one task; everything else is by cells.  Null texts have size 0 and are
never taken.  Rows with a null doc_id take part like others; rows that repeat a doc_id are
rounded each for itself.  Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lintlake.llm.common import buffers, table, word_bounds, written

QUERY_NAME = "op5_mixing"
MOST_COPIES = 3
BLOCK_ROWS = 256
FAN_IN = 256
SEED = 20240601


@F.arrow_udf(T.LongType())
def word_count(text: pa.Array) -> pa.Array:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; null has none."""
    out = []
    for at in range(0, len(text), 1024):
        _, _, first = word_bounds(*buffers(text.slice(at, 1024)))
        out.append(np.diff(first))
    return pa.array(np.concatenate([np.zeros(0, np.int64), *out]), pa.int64())


def source_targets(sizes: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, target) of (source, size) rows.

    Targets are ``min(weight * x, most * source_size)`` with the one x that uses all words:
    sources are filled in the order of ``most * source_size / weight`` until the rest is enough
    for all that follow.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("w", (1 + F.pmod(F.row_number().over(by_name) - 1, F.lit(3))).cast("double")).withColumn("cap", (F.col("source_size") * most).cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    s = s.withColumns({
        "words_left": F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "weight_left": F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))})
    s = s.withColumn("x", F.col("words_left") / F.col("weight_left")).withColumn("full", F.col("cap") <= F.col("w") * F.col("x"))
    x = F.first(F.when(~F.col("full"), F.col("x")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return s.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("w") * x))).select("source", "source_size", "target")


def _chance(name: str) -> float:
    return xxhash.xxh3_64_intdigest(name) / 2.0 ** 64


def pivot(p: np.ndarray, names: list[str]) -> tuple[np.ndarray, int]:
    """Round the fractions ``p`` in order, two at a time; the place of the one left open, or -1."""
    p = p.astype(float).copy()
    held = -1
    for i in range(len(p)):
        if not 1e-12 < p[i] < 1 - 1e-12:
            p[i] = round(p[i])
            continue
        if held < 0:
            held = i
            continue
        a, b = p[held], p[i]
        u = _chance(f"{SEED}:{names[held]}:{names[i]}")
        if a + b < 1:
            winner, loser = (held, i) if u < a / (a + b) else (i, held)
            p[winner], p[loser] = a + b, 0.0
            held = winner
        else:
            winner, loser = (held, i) if u < (1 - b) / (2 - a - b) else (i, held)
            p[winner], p[loser] = 1.0, a + b - 1
            held = loser
        if not 1e-12 < p[held] < 1 - 1e-12:
            p[held] = round(p[held])
            held = -1
    return p, held


def _pivot_rows(t: pa.Table, last: bool) -> pa.Table:
    t = t.sort_by([("size", "ascending"), ("name", "ascending")])
    names = t.column("name").to_pylist()
    p, held = pivot(t.column("p").to_numpy(), names)
    if last and held >= 0:
        p[held] = float(_chance(f"{SEED}:{names[held]}") < p[held])
        held = -1
    return t.set_column(t.column_names.index("p"), "p", pa.array(p)).set_column(
        t.column_names.index("open"), "open", pa.array(np.arange(len(p)) == held))


def mix(docs: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """(doc_id, row, size, source, source_size, target, copies) for every row of ``docs``.

    ``row`` numbers the rows that agree in doc_id, source and size.
    """
    sized = docs.select("doc_id", "source", word_count(F.col("text").cast("binary")).alias("size"))
    # rows that cannot be told apart travel as one until they are rounded
    sized = written(sized.groupBy("doc_id", "source", "size").count(), "sized")
    targets = written(source_targets(sized.select("source", (F.col("size") * F.col("count")).alias("size")), most), "targets")
    kind = F.floor(8 * F.log2(F.col("size") + F.lit(1.0))).cast("int")
    cells = written(sized.groupBy("source", kind.alias("kind")).agg(F.ceil(F.sum("count") / BLOCK_ROWS).cast("int").alias("blocks")), "cells")
    near = sized.withColumn("kind", kind)
    key = near.source.eqNullSafe(targets.source)
    per_source = targets.join(cells, cells.source.eqNullSafe(targets.source)).select(
        targets.source, "source_size", "target", "kind", "blocks").withColumn(
        "rate", F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0))
    # one row for each source and class of sizes (some hundreds of classes at most)
    per_source = written(per_source, "rates")
    key = near.source.eqNullSafe(per_source.source) & (near.kind == per_source.kind)
    rows = near.join(per_source, key).select("doc_id", near.source, near.kind, "size", "count", "source_size", "target", "rate", "blocks")
    rows = rows.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("count")))).withColumns({
        "name": F.concat_ws(":", F.col("doc_id").cast("string"), "source", "size", "row"),
        "block": F.pmod(F.xxhash64("doc_id", "row"), F.col("blocks")).cast("int"),
        "whole": F.floor("rate").cast("long"), "p": F.col("rate") - F.floor("rate"), "open": F.lit(True)}).drop("count", "rate")
    done = []
    schema = rows.schema
    deepest = cells.agg(F.max("blocks")).first()[0] or 1
    keys = ["source", "kind", "block"]
    level = written(rows.groupBy(*keys).applyInArrow(lambda t: _pivot_rows(t, False), schema), "rounded")
    while True:
        done.append(level.where("NOT open"))
        left = level.where("open")
        if deepest > 1:
            deepest = -(-deepest // FAN_IN)
            left = left.withColumn("block", F.floor(F.col("block") / FAN_IN).cast("int"))
            level = written(left.groupBy(*keys).applyInArrow(lambda t: _pivot_rows(t, False), schema), "rounded")
            continue
        done.append(left.groupBy("source").applyInArrow(lambda t: _pivot_rows(t, True), schema))
        break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("doc_id", "row", "size", "source", "source_size", "target", (F.col("whole") + F.col("p").cast("long")).alias("copies"))


def mixed(docs: DataFrame) -> DataFrame:
    """The mixture itself: each row of ``docs`` as often as it is taken."""
    names = [f"__mix_{n}" for n in ("id", "no_id", "source", "no_source", "size")]
    key = lambda size: [F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), F.coalesce("source", F.lit("")), F.col("source").isNull(), size]
    copies = mix(docs).groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("__mix_copies"), F.count("*").alias("__mix_rows"))
    copies = copies.select(*[c.alias(n) for n, c in zip(names, key(F.col("size")))], "__mix_copies", "__mix_rows")
    found = docs.withColumns(dict(zip(names, key(word_count(F.col("text").cast("binary")))))).join(copies, names)
    # rows that cannot be told apart share their copies out: the first gets what does not divide
    found = found.withColumn("__mix_n", F.row_number().over(Window.partitionBy(*names).orderBy(F.xxhash64("text"))))
    more = F.when(F.col("__mix_n") <= F.col("__mix_copies") % F.col("__mix_rows"), 1).otherwise(0)
    found = found.withColumn("__mix_mine", (F.floor(F.col("__mix_copies") / F.col("__mix_rows")) + more).cast("int")).where("__mix_mine > 0")
    return found.withColumn("__mix_n", F.explode(F.sequence(F.lit(1), F.col("__mix_mine")))).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


SQL = None
