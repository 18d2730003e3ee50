"""Merkle manifest of a dataset: stored levels as parent-linked node rows, proofs by a recursive query.

Each row is a leaf: the digest of its columns.  The leaves of a partition value (``lang``) are
numbered in order, and runs of two consecutive nodes become one until one is left, the subroot;
subroots, in the order of their values, become the root in the same way.

``build`` stores the tree as node rows.  A stored row stands for a node of every ``STRIDE``-th
level and names its parent row; between the two lie the siblings of up to ``STRIDE`` levels, which the
row holds from the lowest up, so that a step of the recursion climbs a stride and not a single level.
``climb`` is the recursive query: it starts at the leaves, appends the siblings of each row that it
passes to the proof and folds the digest of what the leaf holds now, up to the root.  A parent
row has a copy for every ``PER_COPY`` leaves below it, so no join key has more rows than that.

Order within a partition value: order column (null first), then digest; rows that are equal in
all columns hashed are interchangeable.  Null columns count as ``-`` and a null partition value is
a value of its own, before all others.  Empty texts have length 0; long texts are hashed whole.  Rows that
repeat an id are leaves each.  An empty table has no rows, no subroots and no root.  Other
columns are neither read nor hashed.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.llm.common import numbered, table, written

QUERY_NAME = "op11_merkle"
STRIDE = 8
PER_COPY = 4096
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


@dataclass
class Manifest:
    """Written tables: ``leaves`` (tree, pos, hash, siblings, parent, carried columns), ``nodes`` above them, ``subroots``; ``root`` is null for an empty table."""

    leaves: DataFrame
    nodes: DataFrame
    subroots: DataFrame
    root: str | None


def field(c: Column) -> Column:
    """A value with its length in bytes before it; ``-`` where there is none."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in values]), 256)


def _paired(level: Column) -> Column:
    """The level above: every two consecutive digests become one, the last maybe alone."""
    return F.transform(
        F.sequence(F.lit(0), F.shiftright(F.size(level) - 1, 1)),
        lambda i: F.sha2(F.concat(F.get(level, 2 * i), F.coalesce(F.get(level, 2 * i + 1), F.lit(""))), 256))


def _subtrees(nodes: DataFrame, payload: list[str]) -> DataFrame:
    """One row per ``2 ** STRIDE`` nodes: tree, run, members, leaves, levels (digests above the members, the top's last) and total of the level above."""
    runs = nodes.groupBy("tree", F.shiftright("pos", STRIDE).alias("run")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "hash", "leaves", *payload))).alias("members"), F.first("total").alias("below"), F.sum("leaves").alias("leaves"))
    height = F.least(F.lit(STRIDE), F.ceil(F.log2("below")).cast("int"))
    levels = F.aggregate(
        F.array_repeat(F.lit(0), height), F.array(F.transform("members", lambda m: F.lower(F.hex(m["hash"])))),
        lambda done, _: F.concat(done, F.array(_paired(F.element_at(done, -1)))))
    above = F.transform(F.slice(levels, F.lit(2), height), lambda level: F.transform(level, F.unhex))
    return runs.withColumns({"levels": above, "total": F.ceil(F.col("below") / F.pow(F.lit(2.0), height)).cast("long")})


def _copies(leaves: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(leaves / PER_COPY)).cast("int")


def _linked(runs: DataFrame, payload: list[str], parent: Column) -> DataFrame:
    """The members of the subtrees as node rows: payload, pos, hash, leaves, siblings from the lowest up, parent and the parent's copies."""
    inside = F.pmod(F.col("m.pos"), F.lit(1 << STRIDE)).cast("int")
    siblings = F.transform(
        F.slice("levels", F.lit(1), F.size("levels") - 1),
        lambda level, k: F.coalesce(F.get(level, F.call_function("shiftright", inside, k).bitwiseXOR(F.lit(1))), F.lit(b"")))
    levels = F.concat(F.array(F.transform("members", lambda m: m["hash"])), "levels").alias("levels")
    rows = runs.select("tree", parent.alias("parent"), _copies(F.col("leaves")).alias("copies"), levels, F.explode("members").alias("m"))
    own = [F.col(f"m.{c}").alias(c) for c in ("pos", "hash", "leaves", *payload)]
    return rows.select("tree", *own, siblings.alias("siblings"), "parent", "copies")


def _grown(nodes: DataFrame, payload: list[str], root: Column) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """Node rows of the given nodes, those of the levels above them stride by stride, and the last node of each tree."""
    most = nodes.agg(F.max("total")).first()[0] or 1
    strides = max(1, -(-math.ceil(math.log2(most)) // STRIDE))
    linked, ends = [], []
    for stride in range(strides):
        carried = payload if stride == 0 else []
        runs = written(_subtrees(nodes, carried), "merkle-subtrees")
        parent = F.when(F.col("total") == 1, root).otherwise(F.concat_ws("/", "tree", F.lit(str(stride + 1)), F.col("run").cast("string")))
        linked.append(_linked(runs, carried, parent).withColumn("name", F.concat_ws("/", "tree", F.lit(str(stride)), F.col("pos").cast("string"))))
        tops = runs.select("tree", F.col("run").alias("pos"), "total", "leaves", F.coalesce(F.get(F.get("levels", F.size("levels") - 1), F.lit(0)), F.get("members", F.lit(0))["hash"]).alias("hash"))
        ends.append(tops.where("total = 1"))
        nodes = tops.where("total > 1")
    return linked[0], linked[1:], functools.reduce(DataFrame.unionByName, ends)


def build(rows: DataFrame, values: list[Column], by: Column, order: Column, carried: dict[str, Column] | None = None) -> Manifest:
    """The manifest of ``rows``: leaves hash ``values``, one tree per value of ``by``, ascending by ``order``.

    ``carried`` columns stay with the leaves.
    """
    carried = carried or {}
    # texts are read once, and ``row`` is fixed from here on
    leaves = written(rows.select(
        F.coalesce(F.concat(F.lit("="), by.cast("string")), F.lit("-")).alias("tree"), order.alias("ord"), F.unhex(leaf_digest(values)).alias("hash"),
        F.monotonically_increasing_id().alias("row"), *[c.alias(n) for n, c in carried.items()]), "merkle-leaves")
    nodes = numbered(leaves, ["tree"], ["ord", "hash", "row"]).drop("row", "ord").withColumn("leaves", F.lit(1).cast("long"))
    lowest, above, subroots = _grown(nodes, list(carried), F.concat_ws("/", "tree", F.lit("root")))
    subroots = written(subroots.select(F.lit("all").alias("tree"), F.col("tree").alias("value"), "hash", "leaves"), "merkle-subroots")
    tops, higher, ends = _grown(numbered(subroots, ["tree"], ["value"]), ["value"], F.lit(None).cast("string"))
    tops = tops.withColumns({"name": F.concat_ws("/", "value", F.lit("root")), "subroot": F.col("hash")})
    inner = [f.withColumn("subroot", F.lit(None).cast("binary")) for f in [*above, *higher]]
    columns = ["name", "parent", "copies", "pos", "siblings", "subroot"]
    copies = F.explode(F.sequence(F.lit(0), _copies(F.col("leaves")) - 1)).alias("copy")
    upper = functools.reduce(DataFrame.unionByName, [f.select(*columns, copies) for f in [tops, *inner]])
    end = ends.first()
    return Manifest(lowest.drop("name", "leaves"), written(upper, "merkle-nodes"), subroots, end and bytes(end["hash"]).hex())


_FOLD = """aggregate(transform({n}.siblings, (s, k) -> struct(s, shiftright({n}.pos, k) & 1 AS right)), {start},
  (h, x) -> sha2(IF(x.right = 1, concat(lower(hex(x.s)), h), concat(h, lower(hex(x.s)))), 256))"""
_PROOF = "aggregate({n}.siblings, {start}, (p, s) -> concat(p, s))"


def _climb_sql(carried: list[str]) -> str:
    own = ", ".join(carried)
    start, on = {"n": "n", "start": "lower(hex(n.now))"}, {"n": "n", "start": "lower(hex(c.folded))"}
    return f"""
WITH RECURSIVE climb AS (
  SELECT {own}{', ' if own else ''}n.hash AS leaf, n.pos AS salt, CAST(NULL AS BINARY) AS subroot, n.parent, n.copies,
    unhex({_FOLD.format(**start)}) AS folded, {_PROOF.format(n="n", start="X''")} AS proof
  FROM {{leaves}} n
  UNION ALL
  SELECT {own}{', ' if own else ''}c.leaf, c.salt, coalesce(c.subroot, n.subroot), n.parent, n.copies,
    unhex({_FOLD.format(**on)}), {_PROOF.format(n="n", start="c.proof")}
  FROM climb c JOIN {{nodes}} n ON c.parent = n.name AND pmod(c.salt, c.copies) = n.copy
)
SELECT {own}{', ' if own else ''}leaf, subroot, proof, folded FROM climb WHERE parent IS NULL"""


def climb(manifest: Manifest, now: str, carried: list[str], result: list[Column] | None = None) -> DataFrame:
    """(carried columns, leaf, subroot, proof, folded), a written table with one row per leaf.

    ``proof`` holds the siblings' digests in order, 32 bytes each; ``folded`` is the root that the digest in the
    column ``now`` leads to.  Digests are binary.  ``result`` columns, where given, are written in their place.
    """
    spark = manifest.nodes.sparkSession
    setting = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "-1")  # every leaf climbs, however many there are
    try:
        out = spark.sql(_climb_sql(carried), leaves=manifest.leaves.withColumnRenamed(now, "now"), nodes=manifest.nodes)
        return written(out.select(*result) if result else out, "merkle-proofs")
    finally:
        spark.conf.set(setting, before)


def _hex(digest: str) -> Column:
    return F.lower(F.hex(digest))


def verified(docs: DataFrame) -> DataFrame:
    """Manifest of ``docs`` by language, and each leaf's proof folded from its tampered digest."""
    values = {c: F.col(c) for c in COLUMNS}
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    tampered = values | {"n_chars": F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    manifest = build(docs, list(values.values()), F.col("lang"), F.col("doc_id"), {"doc_id": F.col("doc_id"), "now": F.unhex(leaf_digest(list(tampered.values())))})
    proofs = climb(manifest, "now", ["doc_id"], [F.col("doc_id"), F.col("leaf"), F.col("subroot"), F.sha2(_hex("proof"), 256).alias("proof_sha256"), F.col("folded")])
    root = F.lit(manifest.root).cast("string")
    return proofs.select(
        "doc_id", _hex("leaf").alias("leaf"), _hex("subroot").alias("subroot"), root.alias("root"), "proof_sha256",
        _hex("folded").alias("folded_root"), (_hex("folded") == root).alias("verified"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified(table(spark, sf_dir, "documents"))


SQL = """
WITH RECURSIVE t AS (SELECT doc_id, lang, source, n_chars, text, coalesce('=' || lang, '-') AS tree FROM documents),
crc AS (SELECT list(c ORDER BY i) AS c FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS c FROM range(256) r(i))),
hit AS (SELECT doc_id, CASE WHEN doc_id IS NULL THEN false ELSE xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda a, b: xor(a // 256, c[xor(a % 256, b) + 1])), 4294967295::BIGINT) % 7 = 0 END AS tamper FROM (SELECT DISTINCT doc_id FROM documents), crc),
f AS (SELECT t.doc_id, tree, [coalesce(strlen(x) || ':' || x, '-') FOR x IN [t.doc_id::VARCHAR, source, lang, n_chars::VARCHAR, text]] AS v,
  [coalesce(strlen(x) || ':' || x, '-') FOR x IN [t.doc_id::VARCHAR, source, lang, (n_chars + CASE WHEN tamper THEN 1 ELSE 0 END)::VARCHAR, text]] AS w
  FROM t JOIN hit ON hit.doc_id IS NOT DISTINCT FROM t.doc_id),
l AS (SELECT doc_id, tree, sha256(array_to_string(v, '')) AS leaf, sha256(array_to_string(w, '')) AS now FROM f),
p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l),
grow AS (SELECT tree, 0 AS lev, list(leaf ORDER BY pos) AS h FROM p GROUP BY tree
  UNION ALL SELECT tree, lev + 1, [sha256(h[2 * i + 1] || coalesce(h[2 * i + 2], '')) FOR i IN range((len(h) + 1) // 2)] FROM grow WHERE len(h) > 1),
sub AS (SELECT tree, lev, h[1] AS subroot, row_number() OVER (ORDER BY tree) - 1 AS rank FROM grow WHERE len(h) = 1),
top AS (SELECT 0 AS lev, list(subroot ORDER BY rank) AS h FROM sub
  UNION ALL SELECT lev + 1, [sha256(h[2 * i + 1] || coalesce(h[2 * i + 2], '')) FOR i IN range((len(h) + 1) // 2)] FROM top WHERE len(h) > 1),
steps AS (SELECT tree, lev, h, false AS up FROM grow WHERE len(h) > 1
  UNION ALL SELECT sub.tree, sub.lev + top.lev, top.h, true FROM sub, top WHERE len(top.h) > 1),
path AS (SELECT p.doc_id, p.tree, p.pos, p.leaf, p.now, s.lev, CASE WHEN up THEN rank >> (s.lev - sub.lev) ELSE p.pos >> s.lev END AS place, s.h FROM p JOIN sub ON sub.tree = p.tree JOIN steps s ON s.tree = p.tree),
sib AS (SELECT tree, pos, lev, place % 2 = 1 AS is_right, coalesce(h[xor(place, 1) + 1], '') AS s FROM path),
proof AS (SELECT tree, pos, string_agg(s, '' ORDER BY lev) AS proof FROM sib GROUP BY tree, pos),
fold AS (SELECT tree, pos, 0 AS lev, now AS h FROM p
  UNION ALL SELECT f.tree, f.pos, f.lev + 1, sha256(CASE WHEN is_right THEN s || h ELSE h || s END) FROM fold f JOIN sib ON sib.tree = f.tree AND sib.pos = f.pos AND sib.lev = f.lev),
folded AS (SELECT tree, pos, arg_max(h, lev) AS folded_root FROM fold GROUP BY tree, pos)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM p JOIN sub ON sub.tree = p.tree JOIN folded ON folded.tree = p.tree AND folded.pos = p.pos LEFT JOIN proof ON proof.tree = p.tree AND proof.pos = p.pos,
  (SELECT h[1] AS root FROM top WHERE len(h) = 1)
"""
