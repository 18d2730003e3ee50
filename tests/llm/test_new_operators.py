"""Merkle manifest, vector codes and MinHash groups against brute force: nulls, empty and long texts, ties, repeats, clashing columns."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import DOCS, LONG, documents, random_texts, shingles

from lintlake.llm import gnat, merkle, minhash, vector_codes
from lintlake.llm.common import numbered
from lintlake.llm.star_components import components


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


@pytest.fixture(scope="module")
def hard(spark):
    texts = [None, "", "   \n\t", "one", "ONE", "one two three four", LONG, LONG + " end", "a b c d e " * 30, "Kelvin K İ x"] + random_texts(110, 2)
    rows = [(r[0], r[1], r[2], r[3], None if i % 5 == 0 else i, *r[5:]) for i, r in enumerate(documents(texts))]
    rows += [(None, "no id " * 9, "en", "a", 3, *rows[0][5:]), (None, texts[-1], None, None, None, *rows[0][5:]), (7, "other", "solo", "é", 1, *rows[0][5:]), rows[20], rows[20], rows[9]]
    return spark.createDataFrame(rows, DOCS).repartition(5).cache(), rows


def brute_manifest(rows):
    """doc_id, leaf, subroot, root, proof digest, folded root, verified of every row."""
    leaves = []
    for r in rows:
        now = r[4]
        if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and now is not None:
            now += 1
        v = [r[0], r[3], r[2], r[4], r[1]]
        leaves.append((r[2], r[0], h(*map(field, v)), h(*map(field, [*v[:3], now, v[4]]))))
    trees = defaultdict(list)
    for lang, i, leaf, now in leaves:
        trees[lang].append(((i is not None, i or 0, leaf), i, leaf, now))

    def grow(level):
        levels = [level]
        while len(levels[-1]) > 1:
            last = levels[-1]
            levels.append([h(*last[k:k + 2]) for k in range(0, len(last), 2)])
        return levels

    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    grown = {x: grow([m[2] for m in sorted(trees[x])]) for x in langs}
    top = grow([grown[x][-1][0] for x in langs])
    out = []
    for rank, lang in enumerate(langs):
        for pos, (_, i, leaf, now) in enumerate(sorted(trees[lang])):
            sides, fold = [], now
            for levels, at in ((grown[lang], pos), (top, rank)):
                for level in levels[:-1]:
                    other = level[at ^ 1:(at ^ 1) + 1]
                    sides += other
                    fold = h(*other, fold) if at % 2 else h(fold, *other)
                    at //= 2
            out.append((i, leaf, grown[lang][-1][0], top[-1][0], h(*sides), fold, fold == top[-1][0]))
    return Counter(out)


@pytest.mark.parametrize("stride, per_copy", [(8, 4096), (2, 4), (1, 1)])
def test_manifest(hard, monkeypatch, stride, per_copy):
    monkeypatch.setattr(merkle, "STRIDE", stride)
    monkeypatch.setattr(merkle, "PER_COPY", per_copy)
    df, rows = hard
    before = df.sparkSession.conf.get("spark.sql.cteRecursionRowLimit")
    got = Counter(tuple(r) for r in merkle.verified(df.withColumn("tree", F.lit("x")).withColumn("pos", F.lit(1))).collect())
    assert got == brute_manifest(rows)
    assert df.sparkSession.conf.get("spark.sql.cteRecursionRowLimit") == before
    tampered = [r for r in got.elements() if not r[-1]]
    assert tampered and all(zlib.crc32(str(r[0]).encode()) % 7 == 0 for r in tampered)


def test_manifest_small(spark):
    assert merkle.verified(spark.createDataFrame([], DOCS)).collect() == []
    one = documents(["single"])
    assert Counter(tuple(r) for r in merkle.verified(spark.createDataFrame(one, DOCS)).collect()) == brute_manifest(one)
    many = [(i, "t", f"lang{i}", "s", i, *one[0][5:]) for i in range(40)]  # every tree a single leaf
    assert Counter(tuple(r) for r in merkle.verified(spark.createDataFrame(many, DOCS)).collect()) == brute_manifest(many)


def test_manifest_beyond_the_row_limit(spark):
    rows = [(i, "t", "en" if i % 3 else "de", "s", i, *documents(["x"])[0][5:]) for i in range(300)]
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "50")
    try:
        got = Counter(tuple(r) for r in merkle.verified(spark.createDataFrame(rows, DOCS)).collect())
        assert spark.conf.get("spark.sql.cteRecursionRowLimit") == "50"
    finally:
        spark.conf.set("spark.sql.cteRecursionRowLimit", before)
    assert got == brute_manifest(rows)


def test_numbered(spark):
    r = random.Random(4)
    rows = [(r.choice("aab"), r.randrange(50), i) for i in range(500)]
    got = numbered(spark.createDataFrame(rows, "k string, v int, i int").repartition(6), ["k"], ["v", "i"]).collect()
    for k in "ab":
        want = sorted((v, i) for x, v, i in rows if x == k)
        assert [(g.v, g.i) for g in sorted((g for g in got if g.k == k), key=lambda g: g.pos)] == want
        assert {(g.pos, g.total) for g in got if g.k == k} == {(p, len(want)) for p in range(len(want))}


@pytest.mark.parametrize("spread", [1, 3, 40, 1 << 26])
def test_gnat(spread):
    """Exact nearest points with ties, repeated points and few points, against all distances."""
    r = np.random.default_rng(spread)
    for n in (1, 2, 8, 9, 64, 200):
        points = r.integers(-spread, spread + 1, (n, 4))
        q = np.concatenate([r.integers(-spread, spread + 1, (300, 4)), points])
        at, best = gnat.Gnat(points).nearest(q)
        d = ((q[:, None, :] - points[None, :, :]) ** 2).sum(axis=2)
        assert (best == d.min(axis=1)).all() and (at == d.argmin(axis=1)).all()


def test_gnat_leaves_subtrees_out(monkeypatch):
    r = np.random.default_rng(1)
    centres = r.integers(-10_000, 10_000, (8, 4))
    points = np.concatenate([c + r.integers(-20, 20, (8, 4)) for c in centres])
    seen = []
    inner = gnat.Gnat._visit
    monkeypatch.setattr(gnat.Gnat, "_visit", lambda self, q, rows, best, at: (seen.append(len(rows) * len(self.index)), inner(self, q, rows, best, at))[1])
    gnat.Gnat(points).nearest(points + 1)
    assert sum(seen) < 0.5 * len(points) ** 2


def brute_codes(rows):
    kept = [(i, label, [math.floor(256 * x) for x in v]) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    longest = max(len(v) for _, _, v in kept)
    width = -(-longest // 16)
    kept = [(i, label, [max(-(1 << 26), min(1 << 26, x)) for x in v] + [0] * (16 * width - len(v))) for i, label, v in kept]
    cut = [[tuple(v[p * width:(p + 1) * width]) for p in range(16)] for _, _, v in kept]
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, [float(x) for x in kept[k][2]]))[:64]
    books = [[cut[k][p] for k in first] for p in range(16)]

    def nearest(book, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, y)), e) for e, y in enumerate(book))

    for _ in range(2):
        for p in range(16):
            mine = defaultdict(list)
            for c in cut:
                mine[nearest(books[p], c[p])[1]].append(c[p])
            books[p] = [tuple(sum(col) // len(mine[e]) for col in zip(*mine[e])) if e in mine else y for e, y in enumerate(books[p])]
    out = []
    for (i, label, _), c in zip(kept, cut):
        found = [nearest(books[p], c[p]) for p in range(16)]
        out.append((i, label, bytes(e for _, e in found), sum(d for d, _ in found)))
    of_label = Counter()
    for _, label, _, error in out:
        of_label[label] += error
    return Counter((i, code, error, of_label[label]) for i, label, code, error in out), books


def test_vector_codes(spark):
    r = random.Random(8)
    rows = [(i, [r.gauss(0, 0.2) for _ in range(32)], r.choice([0, 1, 2, None])) for i in range(150)]
    rows += [(200 + i, rows[i][1], 1) for i in range(20)]  # repeated vectors
    rows += [(300, None, 1), (301, [1.0, None] * 16, 1), (302, [float("nan")] * 32, 1), (303, [float("inf")] * 32, 1), (304, [], 2), (305, [0.5], None),
             (306, [1e30] + [0.0] * 31, 0), (None, [0.1] * 32, 2), (5, [0.2] * 32, 0), (307, [0.25] * 32, 9)]
    df = spark.createDataFrame([(*x, "c", 1) for x in rows], "vec_id long, embedding array<double>, label int, code string, error int").repartition(4)
    coded, books = vector_codes.compressed(df)
    want, want_books = brute_codes(rows)
    assert Counter((x.vec_id, bytes(x.code), x.error, x.label_error) for x in coded.select("vec_id", "code", "error", "label_error").collect()) == want
    assert [[tuple(map(int, e)) for e in book] for book in books] == want_books


def test_vector_codes_small(spark):
    kind = "vec_id long, embedding array<float>, label string"
    assert vector_codes.compressed(spark.createDataFrame([], kind))[0].collect() == []
    assert vector_codes.compressed(spark.createDataFrame([(1, None, "a"), (2, [None], "b")], kind))[0].collect() == []
    rows = [(1, [0.5] * 16, "a"), (2, [0.25] * 16, None), (3, [0.5] * 16, None)]
    coded, _ = vector_codes.compressed(spark.createDataFrame(rows, kind))
    assert Counter((x.vec_id, bytes(x.code), x.error, x.label_error) for x in coded.collect()) == brute_codes(rows)[0]


def brute_groups(rows, percent=85):
    sets = [shingles(r[1]) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if rows[i][0] is not None and rows[j][0] is not None and a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= percent * (len(a) + len(b) - both):
                    old, new = group[i], group[j]
                    group = [new if g == old else g for g in group]
    least = {}
    for g, r in zip(group, rows):
        if r[0] is not None:
            least[g] = min(least.get(g, r[0]), r[0])
    return Counter((r[0], len(s), least.get(g), r[0] == least.get(g) or (r[0] is None and least.get(g) is None)) for r, s, g in zip(rows, sets, group))


def groups(df):
    return Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_groups(df).collect())


@pytest.mark.parametrize("chunk", [256, 3])
def test_minhash(hard, monkeypatch, chunk):
    monkeypatch.setattr(minhash, "CHUNK_SETS", chunk)
    df, rows = hard
    assert groups(df) == brute_groups(rows)


def test_minhash_large_region(spark, monkeypatch):
    """A region of several chunks, with chains that its first set does not reach, and sets of other sizes."""
    monkeypatch.setattr(minhash, "CHUNK_SETS", 4)
    base = [f"x{i}" for i in range(160)]
    texts = [" ".join(base[k:k + 100]) for k in range(0, 40, 2)]  # neighbours link, ends do not
    texts += [" ".join([*base[:70], *(f"y{j}" for j in range(30 + k))]) for k in range(8)]
    texts += [" ".join(base[:60 + 3 * k]) for k in range(20)]
    r = random.Random(3)
    for _ in range(60):
        w = list(base[:120])
        for _ in range(r.choice([1, 2, 3, 5, 8])):
            w[r.randrange(120)] = f"z{r.randrange(9)}"
        texts.append(" ".join(w))
    rows = [(i, t) for i, t in enumerate(texts)]
    r.shuffle(rows)
    assert groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)) == brute_groups(rows)


def test_minhash_empty(spark):
    assert groups(spark.createDataFrame([], DOCS)) == Counter()
    assert groups(spark.createDataFrame([(1, None), (2, ""), (None, "a b c d e f")], "doc_id long, text string")) == Counter([(1, 0, 1, True), (2, 0, 2, True), (None, 2, None, True)])


def test_signatures_estimate_similarity():
    r = np.random.default_rng(2)
    flat = r.integers(0, 1 << 63, 3000).astype(np.uint64)
    for share in (0.3, 0.6, 0.85, 0.95):
        cut = int(2000 * share / (1 + share) * 1.5)
        a, b = np.sort(flat[:1500]), np.sort(flat[1500 - cut:3000 - cut])
        true = cut / (3000 - cut)
        s = minhash.signatures([a, b, a])
        assert (s[0] == s[2]).all()
        assert abs((s[0] == s[1]).mean() - true) < 6 * math.sqrt(true * (1 - true) / s.shape[1]) + 0.01


def test_signatures_in_pieces(monkeypatch):
    r = np.random.default_rng(5)
    sets = [np.unique(r.integers(0, 1 << 63, n).astype(np.uint64)) for n in (1, 700, 3, 90, 2000)]
    whole = minhash.signatures(sets)
    monkeypatch.setattr(minhash, "_STEP", 64)
    assert (minhash.signatures(sets) == whole).all()


def test_star_components(spark):
    r = random.Random(6)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + i) for i in range(1, 40)] + [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(80)]
    edges += [(7, 7), (900, 800), (900, 800), (-5, 900)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in parent}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
