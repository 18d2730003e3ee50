"""Written stage tables, hashing of words and sliding windows, and small column helpers."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own_folder: tempfile.TemporaryDirectory | None = None
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where the setting is absent a local session (tests) gets a folder of its own, removed when
    Python ends; on a cluster its absence is an error, since a machine's own folder is not
    seen by the other machines.
    """
    global _own_folder
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_folder is None:
        _own_folder = tempfile.TemporaryDirectory(prefix="lintlake-llm-")
    return "file://" + _own_folder.name


def new_path(spark: SparkSession, what: str) -> str:
    path = f"{shared_dir(spark)}/llm-{what}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def written(df: DataFrame, what: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder: computed once, pruned by column, safe from lost executors."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_by(df: DataFrame, what: str, key: str) -> DataFrame:
    """Like ``written``, bucketed by ``key``: grouping or joining by it later does not move the rows again."""
    spark = df.sparkSession
    name = f"llm_{what}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").option("path", new_path(spark, what)).bucketBy(buckets, key).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # external: the files stay, and the frame knows them
    return out


def written_so_far() -> int:
    return len(_written)


def release(spark: SparkSession, first: int, last: int) -> None:
    """Delete the stage tables numbered first..last-1, once everything read from them is stored elsewhere."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in _written[first:last]:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c) -> F.Column:
    """Lower-case A-Z alone; every other character stays."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- tables kept by a Python worker ----------------------------------------------------------

_kept: dict = {}


def worker_table(key, make):
    """A table that a worker makes once and keeps until another one is asked for.

    Spark uses a worker again for other stages, so tables that stayed would add up.
    """
    if key not in _kept:
        _kept.clear()
        pa.default_memory_pool().release_unused()
        _kept[key] = make()
    return _kept[key]


# --- binary columns in Arrow batches ---------------------------------------------------------


def blob(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def slices(batches, limit: int = 4 << 20, column: str = "text"):
    """Cut record batches so that each holds about ``limit`` bytes of ``column`` (one row at least)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(at, stop - at)
            at = stop


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (first one 0) of a string or binary column; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offs[0]:offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


# --- words and windows -----------------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_TO_LOWER = np.arange(256, dtype=np.uint8)
_TO_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit words (finalizer of a well-known hash)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_B = 0xD6E8FEB86659FD93  # odd, so it has an inverse modulo 2**64
_B_INV = pow(_B, -1, 1 << 64)
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    have = len(_powers[0])
    if have < n:
        size = 1 << (n - 1).bit_length()
        out = []
        for base in (_B, _B_INV):
            p = np.ones(size, np.uint64)
            filled = 1
            while filled < size:
                p[filled:2 * filled] = p[:filled] * np.uint64(pow(base, filled, 1 << 64))
                filled *= 2
            out.append(p)
        _powers = (out[0], out[1])
    return _powers


def lowered(data: np.ndarray) -> np.ndarray:
    return _TO_LOWER[data]


def word_bounds(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and the number of the first word of each text.

    A word never crosses the end of a text.
    """
    n = len(data)
    solid = np.zeros(n + 1, bool)
    solid[:n] = ~_SPACE[data]
    before = np.zeros(n + 1, bool)
    before[1:] = solid[:-1]
    cut = np.zeros(n + 1, bool)
    cut[offs] = True
    starts = np.flatnonzero(solid & (~before | cut))
    ends = np.flatnonzero(before & (~solid | cut))
    return starts, ends, np.searchsorted(starts, offs)


_CHUNK = 1 << 18


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes (polynomial in random byte values, then mixed)."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = int(starts[at])
        if ends[at] - base > _CHUNK:  # a word beyond the power tables
            out[at] = np.uint64(xxhash.xxh3_64_intdigest(data[base:int(ends[at])].tobytes()))
            at += 1
            continue
        stop = int(np.searchsorted(ends, base + _CHUNK, "right"))
        part = data[base:int(ends[stop - 1])]
        power, inverse = _power_tables(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE_VALUE[part] * power[:len(part)], out=sums[1:])
        s, e = starts[at:stop] - base, ends[at:stop] - base
        out[at:stop] = (sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64)
        at = stop
    return mix(out)


def window_hashes(words: np.ndarray, width: int, base: int = _B) -> np.ndarray:
    """Hash of the window of ``width`` words that starts at each word; the last ``width - 1`` are meaningless."""
    n = len(words)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out[:n - k] = out[:n - k] * np.uint64(base) + words[k:]
    return mix(out)


def numbered(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``pos``, the place of each among those of its ``key`` from 0 on, and ``total``, their number.

    One range shuffle sorts all keys at once; a row's place is that in its range and the number of
    rows of its key in earlier ranges, so a key with a third of all rows is dealt out as well.
    ``order`` must tell rows apart, or rows that it leaves equal be interchangeable.  Keys are not null.
    """
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*key, *order]
    placed = written(rows.repartitionByRange(ranges, *by).sortWithinPartitions(*by).withColumns(
        {"range": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "ordered")
    parts = written(placed.groupBy(*key, "range").agg(F.min("at").alias("first"), F.count("*").alias("n_range")), "ranges")
    whole = Window.partitionBy(*key)
    before = whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(*key, "range", "first", F.coalesce(F.sum("n_range").over(before), F.lit(0)).alias("before"), F.sum("n_range").over(whole).alias("total"))
    return placed.join(starts, [*key, "range"]).select(*rows.columns, (F.col("before") + F.col("at") - F.col("first")).alias("pos"), "total")


def pow2_at_least(n: int) -> int:
    return 1 << max(0, int(n - 1).bit_length())
