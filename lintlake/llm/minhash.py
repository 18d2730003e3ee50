"""Near-duplicate groups by MinHash: banded signatures, signature verification, exact confirmation.

1. The signature of a document holds, for ``ROWS * BANDS`` universal hash functions, 16 bits of the
   smallest value over its shingles.  Documents with equal sets form a class with one signature.
2. Classes that agree on all rows of a band are candidates.  Those of a band key get star edges, one
   node of a key leaving each task, and the components of these edges (``star_components``) are regions
   outside of which no candidates lie.
3. In each region pairs whose signatures agree often enough are confirmed on their full sets.  A
   large region is cut in chunks of bounded size, by set size; every chunk also holds guests, the
   sets that agree most with the commonest band keys of the region: copies of one text link with those
   like the text itself.  The links found become
   components by large-star and small-star.  Sets outside their region's largest component then visit the
   other chunks that hold a set of fitting size with one of their band keys: signatures first, full sets only of
   those that agree with somebody.  (Two unconnected sets are not both in that component, so one of them visits.)
4. Links between those components become components again.

With 32 bands of 6 rows a pair of similarity 0.85 shares no band with a probability below 3e-7, and
falls short of the least agreement (six deviations) with 1e-9; all links reported are exact up to
equal 64-bit hashes of shingles.  Null and empty texts have no shingles and stand alone.  A row with a null doc_id
links with nothing, has a null component and is kept.  Rows that repeat a doc_id are judged each by its own
text.  Very long texts are one row of a pack each.  An empty table has no rows.  Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lintlake.llm.common import blob, mix, numbered, table, written
from lintlake.llm.ngram_join import least_common, shingle_sets
from lintlake.llm.packs import opened, write_packs
from lintlake.llm.star_components import components

QUERY_NAME = "op13_minhash"
WIDTH = 5
PERCENT = 85
ROWS = 6
BANDS = 32
CHUNK_SETS = 128
HUBS = 16
CHUNK_TOKENS = 1 << 20
BUCKET_KEYS = 1 << 20
_STEP = 1 << 18


def least_agreement(percent: int) -> int:
    """Equal minima that any linked pair has, short of six deviations of the estimate."""
    n, s = ROWS * BANDS, percent / 100
    return max(ROWS, math.floor(n * s - 6 * math.sqrt(n * s * (1 - s))))


def hash_family(n: int = ROWS * BANDS, seed: int = 13) -> tuple[np.ndarray, np.ndarray]:
    """Multiply-add hashes modulo 2**64: odd factors and summands."""
    r = np.random.default_rng(seed)
    return r.integers(0, 1 << 64, n, np.uint64, endpoint=False) | np.uint64(1), r.integers(0, 1 << 64, n, np.uint64, endpoint=False)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, functions): 16 bits of the smallest hash of each set; sets are not empty."""
    factor, add = hash_family()
    flat = np.concatenate([np.zeros(0, np.uint64), *sets])
    ends = np.cumsum([len(s) for s in sets])
    begins = ends - [len(s) for s in sets]
    least = np.full((len(factor), len(sets)), np.iinfo(np.uint64).max)
    for at in range(0, len(flat), _STEP):  # bounded scratch, also for a very long text
        part = flat[at:at + _STEP]
        mine = slice(int(np.searchsorted(ends, at, "right")), int(np.searchsorted(begins, at + len(part), "left")))
        cuts = np.maximum(begins[mine] - at, 0)
        value = np.empty_like(part)
        for k in range(len(factor)):
            np.multiply(part, factor[k], out=value)
            value += add[k]
            row = least[k, mine]
            np.minimum(row, np.minimum.reduceat(value, cuts), out=row)
    return np.ascontiguousarray((least >> np.uint64(8)).astype(np.uint16).T)


def band_keys(sigs: np.ndarray) -> np.ndarray:
    """(sets, bands): a hash of each band of the signatures."""
    x = sigs.reshape(len(sigs), BANDS, ROWS).astype(np.uint64)
    key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sigs), 1))
    for k in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + x[:, :, k])
    return key


def _sigs_of(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, ROWS * BANDS)


def _signed(packs: DataFrame, width: int) -> DataFrame:
    """(pack, ord, doc_id, n, class_id, sig) of every document; class and signature are null without shingles."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                ids, no_id, _, _ = opened(row)
                sets = shingle_sets(row, width)
                full = [k for k, s in enumerate(sets) if len(s)]
                sigs = dict(zip(full, signatures([sets[k] for k in full]))) if full else {}
                yield pa.RecordBatch.from_pydict({
                    "pack": pa.array([row["pack"]] * len(sets), pa.int64()), "ord": pa.array(range(len(sets)), pa.int64()),
                    "doc_id": pa.array(ids, pa.int64(), mask=no_id), "n": pa.array([len(s) for s in sets], pa.int64()),
                    "class_id": pa.array([xxhash.xxh3_64_intdigest(blob(s)) - (1 << 63) if len(s) else None for s in sets], pa.int64()),
                    "sig": pa.array([blob(sigs[k]) if k in sigs else None for k in range(len(sets))], pa.binary())})

    return written(packs.mapInArrow(run, "pack long, ord long, doc_id long, n long, class_id long, sig binary"), "signatures")


def _star(key: np.ndarray, node: np.ndarray):
    """The smallest node of each key, and edges from it to the key's other nodes."""
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    hub = node[new][np.cumsum(new) - 1]
    return key[new], node[new], np.unique(np.stack([hub, node])[:, hub != node], axis=1)


def _candidates(signed: DataFrame, n: int) -> DataFrame:
    """(a, b): star edges between the classes of each band key."""
    spark = signed.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n * BANDS // BUCKET_KEYS))

    def local(batches):
        me = TaskContext.get().partitionId()
        for batch in batches:
            if batch.num_rows == 0:
                continue
            keys = band_keys(_sigs_of(batch.column("sig")))
            key, hub, edges = _star(keys.ravel(), np.repeat(batch.column("class_id").to_numpy(), BANDS))
            bucket = (key % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            rows = [(int(b), blob(key[order[cuts[b]:cuts[b + 1]]]), blob(hub[order[cuts[b]:cuts[b + 1]]]), None) for b in np.flatnonzero(np.diff(cuts))]
            if edges.size:
                rows.append((me % buckets, b"", b"", blob(edges)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary(), pa.binary()))], ["bucket", "key", "hub", "edges"])

    def meet(t: pa.Table) -> pa.Table:
        key = np.frombuffer(b"".join(t.column("key").to_pylist()), np.uint64)
        hub = np.frombuffer(b"".join(t.column("hub").to_pylist()), np.int64)
        edges = [np.frombuffer(e, np.int64).reshape(2, -1) for e in t.column("edges").to_pylist() if e is not None]
        edges = np.unique(np.concatenate([_star(key, hub)[2], *edges], axis=1), axis=1)
        return pa.table({"a": edges[0], "b": edges[1]})

    rows = signed.select("class_id", "sig").mapInArrow(local, "bucket long, key binary, hub binary, edges binary")
    return rows.groupBy("bucket").applyInArrow(meet, "a long, b long")


def _deal(packs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``wanted`` (pack, ord, ...) with the tokens of its documents, made anew from the packs that hold them."""
    names = [c for c in wanted.columns if c not in ("pack", "ord")]

    def pick(key, left: pa.Table, right: pa.Table) -> pa.Table:
        tokens = []
        if right.num_rows:
            _, _, data, offs = opened({n: left.column(n)[0].as_py() for n in left.column_names})
            ords, place = np.unique(right.column("ord").to_numpy(), return_inverse=True)
            body = b"".join(data[offs[o]:offs[o + 1]].tobytes() for o in ords)
            sizes = np.concatenate([[0], np.cumsum(offs[ords + 1] - offs[ords])]).astype(np.int64)
            sets = [blob(s) for s in shingle_sets({"ids": b"", "no_id": b"", "offs": blob(sizes), "body": body}, width)]
            tokens = [sets[p] for p in place]
        return right.select(names).append_column("tokens", pa.array(tokens, pa.binary()))

    kinds = ", ".join(f"{n} {t}" for n, t in wanted.dtypes if n in names)
    return packs.groupBy("pack").cogroup(wanted.groupBy("pack")).applyInArrow(pick, f"{kinds}, tokens binary")


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int(np.count_nonzero(b[at] == a))


def linked(sets: list[np.ndarray], sigs: np.ndarray, percent: int, known: np.ndarray | None = None, side: np.ndarray | None = None) -> np.ndarray:
    """A group number for each set: signatures that agree often enough, confirmed on the sets.

    Sets of equal ``known`` are together already; with ``side`` only pairs of both sides are tried.
    """
    group = np.arange(len(sets)) if known is None else np.unique(known, return_inverse=True)[1]
    enough = least_agreement(percent)
    for i in range(len(sets) - 1):
        near = np.count_nonzero(sigs[i + 1:] == sigs[i], axis=1) >= enough
        near &= group[i + 1:] != group[i]
        if side is not None:
            near &= side[i + 1:] != side[i]
        for j in np.flatnonzero(near) + i + 1:
            if group[i] == group[j]:
                continue
            a, b = sorted((sets[i], sets[j]), key=len)
            if 100 * len(a) >= percent * len(b):
                both = _overlap(a, b)
                if 100 * both >= percent * (len(a) + len(b) - both):
                    group[group == group[j]] = group[i]
    return group


def _least_of(group: np.ndarray, ids: np.ndarray) -> np.ndarray:
    least = np.full(int(group.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, group, ids)
    return least[group]


def _sets_of(t: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), np.uint64) for x in t.column("tokens")]


def _within(t: pa.Table, percent: int) -> pa.Table:
    """The groups of each chunk of a unit: (class_id, region, chunk, root)."""
    ids, region, chunk = (t.column(c).to_numpy() for c in ("class_id", "region", "chunk"))
    sets, sigs = _sets_of(t), _sigs_of(t.column("sig"))
    root = np.zeros(len(ids), np.int64)
    order = np.lexsort((ids, chunk, region))
    ends = np.flatnonzero(np.diff(region[order], append=0) | np.diff(chunk[order], append=0)) + 1
    for at in np.split(order, sorted({*ends.tolist()} - {len(order)})):
        root[at] = _least_of(linked([sets[i] for i in at], sigs[at], percent), ids[at])
    return pa.table({"class_id": ids, "region": region, "chunk": chunk, "root": root})


_LONGS = ["class_id", "pack", "ord", "root"]


def _as_row(t: pa.Table) -> pa.Table:
    """A chunk as one row of blobs; the chunk is of bounded size."""
    return pa.table({
        **{c: pa.array([t.column(c)[0].as_py()], pa.int64()) for c in ("region", "chunk", "main")},
        **{c: pa.array([blob(t.column(c).to_numpy())], pa.binary()) for c in _LONGS}, "sig": pa.array([b"".join(t.column("sig").to_pylist())], pa.binary())})


def _agreeing(batches, percent: int):
    """Of each pair of chunks the loose sets of the first that agree with sets of the second, and those."""
    enough = least_agreement(percent)
    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
            side = [{c: np.frombuffer(row[f"{at}_{c}"], np.int64) for c in _LONGS} | {"sig": np.frombuffer(row[f"{at}_sig"], np.uint16).reshape(-1, ROWS * BANDS)} for at in ("home", "to")]
            loose = side[0]["root"] != row["main"]
            near = np.zeros((len(loose), len(side[1]["root"])), bool)
            for k in np.flatnonzero(loose):
                near[k] = (np.count_nonzero(side[1]["sig"] == side[0]["sig"][k], axis=1) >= enough) & (side[1]["root"] != side[0]["root"][k])
            for visitor, s, keep in ((True, side[0], near.any(axis=1)), (False, side[1], near.any(axis=0))):
                n = int(keep.sum())
                yield pa.RecordBatch.from_pydict({
                    **{c: pa.array(s[c][keep], pa.int64()) for c in _LONGS}, "sig": pa.array([blob(x) for x in s["sig"][keep]], pa.binary()),
                    "region": pa.array([row["region"]] * n, pa.int64()), "home": pa.array([row["home"]] * n, pa.int64()),
                    "to": pa.array([row["to"]] * n, pa.int64()), "visitor": pa.array([visitor] * n, pa.bool_())})


def _across(t: pa.Table, percent: int) -> pa.Table:
    """Confirmed links between visitors and members of a chunk: edges between their earlier roots."""
    root = t.column("root").to_numpy()
    side = t.column("visitor").to_numpy(zero_copy_only=False)
    least = _least_of(linked(_sets_of(t), _sigs_of(t.column("sig")), percent, root, side), root)
    edges = np.unique(np.stack([least, root])[:, least != root], axis=1)
    return pa.table({"a": edges[0], "b": edges[1]})


def _keys(rows: DataFrame) -> DataFrame:
    """(region, chunk, n, root, main, key) for every band of ``rows``."""
    names = ["region", "chunk", "n", "root", "main"]

    def run(batches):
        for batch in batches:
            keys = band_keys(_sigs_of(batch.column("sig"))) if batch.num_rows else np.zeros((0, BANDS), np.uint64)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(np.repeat(batch.column(c).to_numpy(), BANDS)) for c in names), pa.array(keys.ravel().view(np.int64))], [*names, "key"])

    return rows.select(*names, "sig").mapInArrow(run, ", ".join(f"{c} long" for c in [*names, "key"]))


def _central(rows: DataFrame) -> DataFrame:
    """(region, class_id): the ``HUBS`` sets of each region that hold most of the commonest keys of the bands.

    Each batch counts its own commonest keys alone, which only bears on who is chosen.
    """

    def common(batches):
        for batch in batches:
            region = batch.column("region").to_numpy()
            keys = band_keys(_sigs_of(batch.column("sig"))) if batch.num_rows else np.zeros((0, BANDS), np.uint64)
            out = []
            for r in np.unique(region):
                for band, column in enumerate(keys[region == r].T):
                    value, n = np.unique(column, return_counts=True)
                    out.append((int(r), band, int(value[n.argmax()].view(np.int64)), int(n.max())))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 4)], ["region", "band", "key", "n"])

    def score(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            best = np.full((batch.num_rows, BANDS), 0, np.int64)
            for i, pairs in enumerate(batch.column("best").to_pylist()):
                for pair in pairs:
                    best[i, pair["band"]] = pair["key"]
            same = (band_keys(_sigs_of(batch.column("sig"))).view(np.int64) == best).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("region"), batch.column("class_id"), pa.array(same, pa.int64())], ["region", "class_id", "score"])

    counts = rows.select("region", "sig").mapInArrow(common, "region long, band long, key long, n long").groupBy("region", "band", "key").agg(F.sum("n").alias("n"))
    best = counts.groupBy("region", "band").agg(F.max_by("key", "n").alias("key")).groupBy("region").agg(F.collect_list(F.struct("band", "key")).alias("best"))
    scored = rows.select("region", "class_id", "sig").join(written(best, "commonest"), "region").mapInArrow(score, "region long, class_id long, score long")
    first = Window.partitionBy("region").orderBy(F.desc("score"), "class_id")
    return written(scored.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= HUBS).select("region", "class_id"), "central")


def _planned(members: DataFrame) -> DataFrame:
    """``members`` with a chunk and a unit of work: small regions share units, large ones have a unit per chunk, with guests from the others."""
    sizes = written(members.groupBy("region").agg(F.count("*").alias("sets"), F.sum("n").alias("tokens_in")), "sizes")
    big = (F.col("sets") > CHUNK_SETS) | (F.col("tokens_in") > CHUNK_TOKENS)
    small_tokens = sizes.where(~big).agg(F.sum("tokens_in")).first()[0] or 0
    bins = max(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-small_tokens // (2 * CHUNK_TOKENS)))
    of = written(members.join(sizes, "region").withColumn("big", big).drop("sets", "tokens_in"), "of-region")
    small = of.where("NOT big").withColumns({"chunk": F.lit(-1).cast("long"), "unit": F.pmod(F.xxhash64("region"), F.lit(bins))})
    if of.where("big").isEmpty():
        return written(small.withColumn("guest", F.lit(False)), "plan")
    # sets of like size share a chunk, the fewer the larger they are
    wide = of.where("big").withColumn("scale", F.greatest(F.lit(12), F.ceil(F.log2(F.col("n")))).cast("int"))
    room = F.greatest(F.lit(1), F.least(F.lit(CHUNK_SETS), F.call_function("shiftright", F.lit(CHUNK_TOKENS), F.col("scale"))))
    placed = numbered(wide, ["region", "scale"], ["n", "class_id"])
    large = placed.withColumn("chunk", F.col("scale").cast("long") * (1 << 40) + F.floor(F.col("pos") / room)).drop("scale", "pos", "total")
    large = written(large.join(_central(wide).withColumn("goes", F.lit(True)), ["region", "class_id"], "left").withColumn("goes", F.coalesce("goes", F.lit(False))), "chunks")
    hubs = large.where("goes").withColumnRenamed("chunk", "own")
    chunks = large.select("region", "chunk").distinct()
    away = hubs.join(chunks, "region").where("chunk != own").drop("own")
    large = large.withColumn("guest", F.lit(False)).unionByName(away.withColumn("guest", F.lit(True))).drop("goes").withColumn("unit", F.xxhash64("region", "chunk"))
    return written(small.withColumn("guest", F.lit(False)).unionByName(large), "plan")


def _visits(big: DataFrame, percent: int) -> DataFrame:
    """The rows to compare across chunks: (class_id, pack, ord, root, sig, region, home, to, visitor)."""
    keyed = written(_keys(big), "keyed")
    size = [F.min("n").alias("low"), F.max("n").alias("high")]
    held = written(keyed.groupBy("region", "key", F.col("chunk").alias("to")).agg(*size), "held")
    asked = written(keyed.where("root != main").groupBy("region", "key", F.col("chunk").alias("home")).agg(F.min("n").alias("least"), F.max("n").alias("most")), "asked")
    fits = (100 * F.col("high") >= percent * F.col("least")) & (100 * F.col("most") >= percent * F.col("low"))
    pairs = written(asked.join(held, ["region", "key"]).where((F.col("to") != F.col("home")) & fits).select("region", "home", "to").distinct(), "visits")
    rows = written(big.groupBy("region", "chunk").applyInArrow(
        _as_row, "region long, chunk long, main long, class_id binary, pack binary, ord binary, root binary, sig binary"), "chunk-rows")

    def named(at: str) -> DataFrame:
        return rows.select("region", F.col("chunk").alias(at), *(["main"] if at == "home" else []), *[F.col(c).alias(f"{at}_{c}") for c in [*_LONGS, "sig"]])

    return pairs.join(named("home"), ["region", "home"]).join(named("to"), ["region", "to"]).mapInArrow(
        lambda batches: _agreeing(batches, percent), "class_id long, pack long, ord long, root long, sig binary, region long, home long, to long, visitor boolean")


def near_groups(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id, kept) for every row of ``docs`` (doc_id, text)."""
    packs = write_packs(docs)
    signed = _signed(packs, width)
    able = signed.where("class_id IS NOT NULL AND doc_id IS NOT NULL")
    n = able.count()
    regions = components(_candidates(able, n)).select(F.col("node").alias("class_id"), F.col("root").alias("region"))
    first = F.min(F.struct("doc_id", "pack", "ord", "n")).alias("first")
    classes = written(able.groupBy("class_id").agg(first).select("class_id", "first.*"), "classes")
    members = regions.join(classes, "class_id").drop("doc_id")
    members = members.join(signed.select("pack", "ord", "sig"), ["pack", "ord"])
    plan = _planned(written(members, "members"))
    found = written(_deal(packs, plan.select("class_id", "pack", "ord", "region", "chunk", "unit", "sig"), width).groupBy("unit").applyInArrow(
        lambda t: _within(t, percent), "class_id long, region long, chunk long, root long"), "found")

    rooted = written(components(found.where("class_id != root").select(F.col("class_id").alias("a"), F.col("root").alias("b"))), "rooted")
    big = written(plan.where("big AND NOT guest").join(rooted.withColumnRenamed("node", "class_id"), "class_id", "left").withColumn("root", F.coalesce("root", "class_id")), "big")
    sizes = written(big.groupBy("region", "root").agg(F.count("*").alias("size")), "component-sizes")
    main = written(sizes.groupBy("region").agg(F.max_by("root", F.struct("size", "root")).alias("main")), "main")
    big = written(big.join(main, "region"), "big-main")
    if not big.where("root != main").isEmpty():
        near = written(_visits(big, percent), "agreeing")
        across = _deal(packs, near, width).groupBy("region", "home", "to").applyInArrow(lambda t: _across(t, percent), "a long, b long")
        joined = written(components(written(across, "across")).select(F.col("node").alias("root"), F.col("root").alias("last")), "joined")
        singles = joined.select(F.col("root").alias("node"), "root")  # roots that no link had reached before
        rooted = written(rooted.union(singles).distinct().join(joined, "root", "left").select("node", F.coalesce("last", "root").alias("root")), "rooted")
    rooted = rooted.withColumnRenamed("node", "class_id")
    named = written(classes.join(rooted, "class_id").select("class_id", "doc_id", "root"), "named")
    least = named.groupBy("root").agg(F.min("doc_id").alias("least"))
    component = written(named.join(written(least, "least"), "root").select("class_id", "least"), "component")
    # a class without links has the smallest id of its equal texts
    own = classes.select("class_id", F.col("doc_id").alias("own"))
    of_class = written(own.join(component, "class_id", "left").select("class_id", F.coalesce("least", "own").alias("component_id")), "of-class")
    empty = signed.where("class_id IS NULL OR doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), "class_id", F.col("doc_id").alias("component_id"))
    rest = able.select("doc_id", F.col("n").alias("n_shingles"), "class_id").join(of_class, "class_id").select("doc_id", "n_shingles", "class_id", "component_id")
    return empty.unionByName(rest).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


SQL = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
pos AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM d WHERE len(w) > 0),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS s FROM pos),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM both_ JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
edge AS (SELECT x, y FROM link UNION SELECT y, x FROM link),
reach AS (SELECT x AS a, x AS b FROM edge UNION SELECT r.a, e.y FROM reach r JOIN edge e ON r.b = e.x),
comp AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(comp.c, d.doc_id) AS component_id, coalesce(comp.c, d.doc_id) IS NOT DISTINCT FROM d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN comp ON comp.a = d.doc_id
"""
