"""Near-duplicate groups: exact Jaccard join on word shingles with signature trees.

1. A count-min sketch of all shingles (``packs``) tells how often each can occur.  Of a document
   that links with another text, at least 80 % of the shingles occur elsewhere; the others are
   alone and done.
2. Documents with equal sets form a class, and one of them stands for it.
3. Linked sets share a shingle among their rarest 20 % (prefix filter; the order is the sketch's
   class of counts, then the hash).  Documents that share one get star edges, and the components
   of these edges are regions outside of which nothing links.
4. In each region a signature tree is traversed with itself (``signature_tree``).  Large regions
   are cut in chunks of bounded size that all hold the region's first set; sets that are not
   reached from it are then compared with all the other chunks.

Sets are compared by 64-bit hashes of their shingles.  Null and empty texts have no shingles and
stand alone.  A row with a null doc_id links with nothing and has a null component.  Rows that
repeat a doc_id are judged each by its own text.  Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.llm.common import blob, lowered, mix, table, window_hashes, word_bounds, word_hashes, written, written_by
from lintlake.llm.components import connected
from lintlake.llm.packs import classes_of, counters, merged_counts, occupied, opened, write_packs
from lintlake.llm.signature_tree import linked_groups

QUERY_NAME = "op1_ngram_join"
WIDTH = 5
PERCENT = 80
CHUNK_SETS = 256
CHUNK_TOKENS = 1 << 20


def shingle_sets(row: dict, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document of a pack."""
    _, _, data, offs = opened(row)
    data = lowered(data)
    starts, ends, first = word_bounds(data, offs)
    words = word_hashes(data, starts, ends)
    windows = window_hashes(words, width)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(windows[a:b - width + 1]))
        elif b > a:  # the whole sequence as one
            h = np.uint64(b - a)
            for w in words[a:b]:
                h = mix(np.array([h ^ w]))[0] + np.uint64(b - a)
            out.append(np.array([h], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def least_common(n, percent: int):
    """Members that a set of n must share with any set that it links with."""
    return -(-percent * n // 100)


def _flat(sets: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint64), *sets])


def _sets_table(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, n, class_id, pack, ord, tokens, prefix, digest); tokens, prefix and the text's digest only where a link is possible."""
    packs = write_packs(docs)
    total = packs.agg(F.sum(F.col("n_words") + F.col("n_docs"))).first()[0] or 0
    bits, _ = counters(total)
    counts = merged_counts(packs, lambda row: _flat(shingle_sets(row, width)), total)

    def keep(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = {k: [] for k in ("n", "class_id", "ord", "tokens", "prefix", "digest")}
        ids, no_id, pack = np.zeros(0, np.int64), np.zeros(0, bool), 0
        if left.num_rows:
            row = {n: left.column(n)[0].as_py() for n in left.column_names}
            pack = row["pack"]
            ids, no_id, data, offs = opened(row)
            sets = shingle_sets(row, width)
            flat = _flat(sets)
            classes = classes_of(right)[occupied(flat, bits)[1]] if len(flat) else np.zeros(0, np.uint8)
            at = 0
            for i, s in enumerate(sets):
                mine = classes[at:at + len(s)]
                at += len(s)
                need = least_common(len(s), percent)
                open_ = bool(len(s)) and not no_id[i] and np.count_nonzero(mine) >= need
                out["n"].append(len(s))
                out["ord"].append(i)
                out["class_id"].append(xxhash.xxh3_64_intdigest(blob(s)) - (1 << 63) if len(s) else None)
                out["tokens"].append(blob(s) if open_ else None)
                out["prefix"].append(blob(s[np.argsort(mine, kind="stable")[:len(s) - need + 1]]) if open_ else None)
                out["digest"].append(hashlib.sha256(data[offs[i]:offs[i + 1]]).digest() if open_ else None)
        return pa.table({
            "doc_id": pa.array(ids, mask=no_id), "n": pa.array(out["n"], pa.int64()), "class_id": pa.array(out["class_id"], pa.int64()),
            "pack": pa.array([pack] * len(ids), pa.int64()), "ord": pa.array(out["ord"], pa.int64()),
            "tokens": pa.array(out["tokens"], pa.binary()), "prefix": pa.array(out["prefix"], pa.binary()),
            "digest": pa.array(out["digest"], pa.binary())})

    return written_by(packs.groupBy("pack").cogroup(counts.groupBy("pack")).applyInArrow(
        keep, "doc_id long, n long, class_id long, pack long, ord long, tokens binary, prefix binary, digest binary"), "sets", "pack")


def _deal(open_: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (pack, ord, ...) with the tokens of its sets, which leave their pack only here."""
    names = [c for c in wanted.columns if c not in ("pack", "ord")]

    def pick(key, left: pa.Table, right: pa.Table) -> pa.Table:
        place = {o: i for i, o in enumerate(left.column("ord").to_pylist())}
        at = pa.array([place[o] for o in right.column("ord").to_pylist()], pa.int64())
        return right.select(names).append_column("tokens", left.column("tokens").take(at))

    kinds = ", ".join(f"{n} {t}" for n, t in wanted.dtypes if n in names)
    return open_.select("pack", "ord", "tokens").groupBy("pack").cogroup(wanted.groupBy("pack")).applyInArrow(pick, f"{kinds}, tokens binary")


def _stars(token: np.ndarray, node: np.ndarray):
    """Of (token, node) pairs: the smallest node of each token, and an edge from it to each other node of the token."""
    order = np.lexsort((node, token))
    token, node = token[order], node[order]
    new = np.ones(len(token), bool)
    new[1:] = token[1:] != token[:-1]
    hub = node[new][np.cumsum(new) - 1]
    edges = np.unique(np.stack([hub, node])[:, hub != node], axis=1)
    return token[new], node[new], edges


def _prefix_edges(sets: DataFrame, buckets: int) -> DataFrame:
    """(a, b): star edges between classes that share a prefix shingle; a task sends one node of each shingle."""

    def local(batches):
        me = TaskContext.get().partitionId()
        for batch in batches:
            if batch.num_rows == 0:
                continue
            prefix = [np.frombuffer(x.as_py(), np.uint64) for x in batch.column("prefix")]
            node = np.repeat(batch.column("class_id").to_numpy(), [len(p) for p in prefix])
            token, hub, edges = _stars(np.concatenate(prefix), node)
            bucket = (token % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            rows = [(b, blob(token[order[x:y]]), blob(hub[order[x:y]]), None) for b, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])) if y > x]
            if edges.size:
                rows.append((me % buckets, b"", b"", blob(edges)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary(), pa.binary()))], ["bucket", "token", "hub", "edges"])

    def meet(t: pa.Table) -> pa.Table:
        token = np.frombuffer(b"".join(t.column("token").to_pylist()), np.uint64)
        hub = np.frombuffer(b"".join(t.column("hub").to_pylist()), np.int64)
        edges = [np.frombuffer(e, np.int64).reshape(2, -1) for e in t.column("edges").to_pylist() if e is not None]
        edges = np.unique(np.concatenate([_stars(token, hub)[2], *edges], axis=1), axis=1)
        return pa.table({"a": edges[0], "b": edges[1]})

    rows = sets.where("prefix IS NOT NULL").select("class_id", "prefix").mapInArrow(local, "bucket long, token binary, hub binary, edges binary")
    return written(rows.groupBy("bucket").applyInArrow(meet, "a long, b long").distinct(), "edges")


def _group_rows(t: pa.Table, percent: int) -> pa.Table:
    """Signature-tree join in each region of a unit: (class_id, region, chunk, root)."""
    region = t.column("region").to_numpy()
    out = {"class_id": [], "region": [], "chunk": [], "root": []}
    ids, chunk = t.column("class_id").to_numpy(), t.column("chunk").to_numpy()
    tokens = t.column("tokens")
    for r in np.unique(region):
        at = np.flatnonzero(region == r)
        group = linked_groups([np.frombuffer(tokens[int(i)].as_py(), np.uint64) for i in at], percent)
        least = np.full(int(group.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, group, ids[at])
        for k, v in (("class_id", ids[at]), ("region", region[at]), ("chunk", chunk[at]), ("root", least[group])):
            out[k].append(v)
    return pa.table({k: np.concatenate(v) for k, v in out.items()})


def _cross_rows(t: pa.Table, percent: int) -> pa.Table:
    """Links between the visitors and the members of a chunk: edges between their earlier roots."""
    root = t.column("root").to_numpy()
    sets = [np.frombuffer(x.as_py(), np.uint64) for x in t.column("tokens")]
    group = linked_groups(sets, percent, known=root, side=t.column("visitor").to_numpy(zero_copy_only=False).astype(np.int8))
    least = np.full(int(group.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, group, root)
    edges = np.unique(np.stack([least[group], root])[:, least[group] != root], axis=1)
    return pa.table({"a": edges[0], "b": edges[1]})


def similar_groups(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id) for every row of ``docs`` (doc_id, text)."""
    return _groups(docs, width, percent).drop("root", "digest")


def _groups(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``similar_groups`` with the group's root and the text's digest; both are null where no link is possible."""
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sets = _sets_table(docs, width, percent)
    open_ = sets.where("tokens IS NOT NULL")
    first = F.min(F.struct("doc_id", "pack", "ord", "n")).alias("first")
    classes = written(open_.groupBy("class_id").agg(first).select("class_id", "first.*"), "classes")

    regions = connected(_prefix_edges(sets, buckets))
    members = written(regions.select(F.col("node").alias("class_id"), F.col("root").alias("region")).join(classes, "class_id"), "members")
    chunks = F.greatest(F.ceil(F.count("*") / CHUNK_SETS), F.ceil(F.sum("n") / CHUNK_TOKENS)).cast("int")
    sizes = written(members.groupBy("region").agg(chunks.alias("chunks"), F.sum("n").alias("region_tokens")), "sizes")
    small = sizes.where("chunks = 1").agg(F.sum("region_tokens")).first()[0] or 0
    bins = max(1, -(-small // (2 * CHUNK_TOKENS)), buckets)
    # small regions share units; a large one has a unit per chunk, and its first set is in each of them
    every = F.when(F.col("class_id") == F.col("region"), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(
        F.array(F.pmod(F.xxhash64("class_id"), F.col("chunks")).cast("int")))
    plan = members.join(sizes, "region").withColumn("chunk", F.explode(every)).withColumn(
        "unit", F.when(F.col("chunks") == 1, F.pmod(F.xxhash64("region"), F.lit(bins))).otherwise(F.xxhash64("region", "chunk"))).withColumn(
        "single", F.col("chunks") == 1)
    plan = written(plan.select("class_id", "pack", "ord", "region", "chunk", "unit", "single"), "plan")
    found = _deal(open_, plan).groupBy("unit", "single").applyInArrow(
        lambda t: _group_rows(t, percent), "class_id long, region long, chunk int, root long")
    found = written(found, "found")

    big = plan.where("NOT single").join(found, ["class_id", "region", "chunk"])
    loose = written(big.where("root != region").select("class_id", "pack", "ord", "region", "chunk", "root"), "loose")
    roots = found.select("class_id", "root").distinct()
    if not loose.isEmpty():
        blocks = loose.groupBy("region").agg(F.ceil(F.count("*") / CHUNK_SETS).cast("int").alias("blocks"))
        blocks = written(blocks.join(sizes, "region"), "blocks")
        visiting = loose.join(blocks, "region").withColumn("to", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).where("to != chunk").select(
            "class_id", "pack", "ord", "region", "to", F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int").alias("block"), "root", F.lit(True).alias("visitor"))
        at_home = big.join(blocks, "region").select(
            "class_id", "pack", "ord", "region", F.col("chunk").alias("to"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "root", F.lit(False).alias("visitor"))
        cross = _deal(open_, visiting.unionByName(at_home)).groupBy("region", "to", "block").applyInArrow(
            lambda t: _cross_rows(t, percent), "a long, b long")
        joined = written(connected(written(cross.distinct(), "cross")).withColumnRenamed("root", "final"), "joined")
        roots = written(roots, "roots")
        roots = roots.join(joined, roots.root == joined.node, "left").select("class_id", F.coalesce("final", "root").alias("root"))

    rooted = written(classes.join(roots, "class_id", "left").select("class_id", "doc_id", F.coalesce("root", "class_id").alias("root")), "rooted")
    least = written(rooted.groupBy("root").agg(F.min("doc_id").alias("component")), "least")
    component = written(rooted.join(least, "root").select("class_id", "component", "root"), "component")
    alone = sets.select("doc_id", F.col("n").alias("n_shingles"), "class_id", F.col("tokens").isNull().alias("alone"), "digest")
    done = alone.where("alone").select("doc_id", "n_shingles", "class_id", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("root"), "digest")
    rest = alone.where("NOT alone").join(component, "class_id").select("doc_id", "n_shingles", "class_id", F.col("component").alias("component_id"), "root", "digest")
    return done.unionByName(rest)


def one_of_each(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row of ``docs`` for each group: that of the smallest doc_id, then of the smallest text digest; rows with a null doc_id stay."""
    linked = written(_groups(docs, width, percent).where("root IS NOT NULL").select("root", "component_id", "doc_id", "digest"), "linked")
    texts = written(linked.where("component_id = doc_id").groupBy("root", "doc_id", "digest").agg(F.count("*").alias("n")), "texts")
    first = texts.groupBy("root").agg(F.min("digest").alias("first"))
    key = [F.col("doc_id").alias("__near_id"), F.col("digest").alias("__near_digest")]
    drop = linked.where("component_id < doc_id").select(*key).unionByName(texts.join(first, "root").where("digest > first").select(*key))
    names = ["__near_id", "__near_digest"]
    keyed = docs.withColumns({"__near_id": F.col("doc_id").cast("long"), "__near_digest": F.unhex(F.sha2(F.col("text").cast("string").cast("binary"), 256))})
    kept = keyed.join(drop, names, "left_anti")
    copies = texts.where("n > 1").select(*key)
    if not copies.isEmpty():  # the same text again under the same doc_id
        kept = kept.join(copies, names, "left_anti").unionByName(kept.join(copies, names, "left_semi").dropDuplicates(names))
    return kept.drop(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


SQL = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
pos AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM d WHERE len(w) > 0),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS s FROM pos),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM both_ JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
edge AS (SELECT x, y FROM link UNION SELECT y, x FROM link),
reach AS (SELECT x AS a, x AS b FROM edge UNION SELECT r.a, e.y FROM reach r JOIN edge e ON r.b = e.x),
comp AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(comp.c, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN comp ON comp.a = d.doc_id
"""
