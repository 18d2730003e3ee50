"""Removal of passages that an earlier document holds: windows of words, found by a count-min prefilter.

First pass: merged sketches of all packs overestimate how often each window occurs
(``packs.merged_counts``).  Second pass: only the windows estimated repeated are grouped
exactly, by 96 bits, to find the smallest doc_id of each: the 64-bit hash and 32 bits of another
one, made of other hashes of the words.  A window counted once
is alone, so none is lost.  Third pass: the words covered by windows that a smaller doc_id
holds are removed.

A null text has no words.  A row with a null doc_id has no place in the order: it loses nothing
and takes nothing from others.  Rows that repeat a doc_id count as one document for the
comparison of ids, so they take nothing from each other.  Other columns are not read.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.llm.common import blob, table, window_hashes, word_bounds, word_hashes
from lintlake.llm.packs import classes_of, counters, merged_counts, occupied, opened, write_packs

QUERY_NAME = "op10_substring_dedup"
WIDTH = 13
_SECOND = 0x9E3779B97F4A7C15  # odd, and not the base of the first hash


class _Windows:
    """The windows of a pack's documents that have an id."""

    def __init__(self, row: dict, width: int):
        self.ids, self.no_id, self.data, self.offs = opened(row)
        self.starts, self.ends, self.first = word_bounds(self.data, self.offs)
        self.words = word_hashes(self.data, self.starts, self.ends)
        n_words = np.diff(self.first)
        n_windows = np.where(self.no_id, 0, np.maximum(n_words - width + 1, 0))
        self.doc = np.repeat(np.arange(len(n_windows)), n_windows)
        before = np.cumsum(n_windows) - n_windows
        self.at = np.arange(len(self.doc)) + np.repeat(self.first[:-1] - before, n_windows)
        self.hashes = window_hashes(self.words, width)[self.at]
        self.width = width

    def second(self, chosen: np.ndarray) -> np.ndarray:
        """32 bits more of the chosen windows, from hashes that share nothing with the first ones."""
        at = self.at[chosen]
        mark = np.zeros(len(self.starts) + 1, np.int64)
        np.add.at(mark, at, 1)
        np.add.at(mark, at + self.width, -1)
        used = np.flatnonzero(np.cumsum(mark[:-1]))  # words in a chosen window
        body, words = self.data.tobytes(), np.zeros(len(self.starts), np.uint64)
        words[used] = [xxhash.xxh3_64_intdigest(body[a:b]) for a, b in zip(self.starts[used].tolist(), self.ends[used].tolist())]
        return (window_hashes(words, self.width, base=_SECOND)[at] >> np.uint64(32)).astype(np.uint32)

    def suspects(self, classes: np.ndarray, bits: int):
        """The different windows estimated repeated: hash, second hash, smallest doc_id; and each suspect's number among them."""
        _, place, _ = occupied(self.hashes, bits)
        chosen = np.flatnonzero(classes[place] > 0) if len(place) else place
        h, h2, doc_id = self.hashes[chosen], self.second(chosen), self.ids[self.doc[chosen]]
        order = np.lexsort((doc_id, h2, h))
        h, h2, doc_id = h[order], h2[order], doc_id[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])
        number = np.empty(len(h), np.int64)
        number[order] = np.cumsum(new) - 1
        return chosen, number, h[new], h2[new], doc_id[new]


def _rows(t: pa.Table) -> dict:
    return {n: t.column(n)[0].as_py() for n in t.column_names}


def remove_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text): each document without the words of repeated windows."""
    packs = write_packs(docs)
    total = packs.agg(F.sum("n_words")).first()[0] or 0
    bits, segment_bits = counters(total)
    counts = merged_counts(packs, lambda row: _Windows(row, width).hashes, total)

    def ask(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"bucket": [], "pack": [], "h": [], "h2": [], "doc": [], "docs": []}
        if left.num_rows:
            row = _rows(left)
            w = _Windows(row, width)
            _, _, h, h2, doc_id = w.suspects(classes_of(right), bits)
            cuts = np.searchsorted(h >> np.uint64(64 - segment_bits), np.arange((1 << segment_bits) + 1).astype(np.uint64)) if segment_bits else [0, len(h)]
            for b in range(1 << segment_bits):
                part = slice(int(cuts[b]), int(cuts[b + 1]))
                if part.stop > part.start:
                    docs, which = np.unique(doc_id[part], return_inverse=True)
                    for k, v in (("bucket", b), ("pack", row["pack"]), ("h", blob(h[part])), ("h2", blob(h2[part])), ("doc", blob(which.astype(np.uint32))), ("docs", blob(docs))):
                        out[k].append(v)
        kinds = {"bucket": pa.int64(), "pack": pa.int64()}
        return pa.table({k: pa.array(v, kinds.get(k, pa.binary())) for k, v in out.items()})

    def answer(t: pa.Table) -> pa.Table:
        h = [np.frombuffer(x.as_py(), np.uint64) for x in t.column("h")]
        sizes = [len(x) for x in h]
        h = np.concatenate(h)
        h2 = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in t.column("h2")])
        own = np.concatenate([np.frombuffer(d.as_py(), np.int64)[np.frombuffer(x.as_py(), np.uint32)] for d, x in zip(t.column("docs"), t.column("doc"))])
        order = np.lexsort((own, h2, h))
        new = np.ones(len(h), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (h2[order][1:] != h2[order][:-1])
        least = own[order][new][np.cumsum(new) - 1]
        earlier = np.empty(len(h), np.uint8)
        earlier[order] = least < own[order]
        parts = np.split(earlier, np.cumsum(sizes)[:-1])
        return pa.table({"pack": t.column("pack"), "segment": t.column("bucket"), "earlier": pa.array([blob(np.packbits(p)) for p in parts], pa.binary()),
                         "n": pa.array(sizes, pa.int64())})

    asked = packs.groupBy("pack").cogroup(counts.groupBy("pack")).applyInArrow(
        ask, "bucket long, pack long, h binary, h2 binary, doc binary, docs binary")
    answers = asked.groupBy("bucket").applyInArrow(answer, "pack long, segment long, earlier binary, n long")
    both = counts.select("pack", "segment", "classes", F.lit(None).cast("binary").alias("earlier"), F.lit(None).cast("long").alias("n")).unionByName(
        answers.select("pack", "segment", F.lit(None).cast("binary").alias("classes"), "earlier", "n"))

    def remove(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept_text": pa.array([], pa.string())}
        if left.num_rows == 0:
            return pa.table(out)
        w = _Windows(_rows(left), width)
        told = right.filter(pa.compute.is_valid(right.column("classes")))
        chosen, number, _, _, least = w.suspects(classes_of(told), bits)
        found = right.filter(pa.compute.is_valid(right.column("earlier"))).sort_by("segment")
        earlier = np.concatenate([np.zeros(0, np.uint8), *(np.unpackbits(np.frombuffer(e.as_py(), np.uint8))[:n.as_py()] for e, n in zip(found.column("earlier"), found.column("n")))])
        hit = (earlier[number] > 0) | (least[number] < w.ids[w.doc[chosen]]) if len(number) else np.zeros(0, bool)
        mark = np.zeros(len(w.starts) + 1, np.int64)
        at = w.at[chosen[hit]]
        np.add.at(mark, at, 1)
        np.add.at(mark, at + width, -1)
        gone = np.cumsum(mark[:-1]) > 0
        n_removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[w.first])
        body, texts = w.data.tobytes(), []
        for i in range(len(w.ids)):
            words = body[w.offs[i]:w.offs[i + 1]].split()
            texts.append(b" ".join(compress(words, ~gone[w.first[i]:w.first[i + 1]]) if n_removed[i] else words))
        return pa.table({
            "doc_id": pa.array(w.ids, mask=w.no_id), "n_words": pa.array(np.diff(w.first), pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
            "kept_text": pa.array(texts, pa.binary()).cast(pa.string())})

    return packs.groupBy("pack").cogroup(both.groupBy("pack")).applyInArrow(
        remove, "doc_id long, n_words long, n_removed long, kept_text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
pos AS (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 12, 0))) AS p FROM d WHERE len(w) >= 13 AND doc_id IS NOT NULL),
win AS (SELECT doc_id, p, array_to_string(w[p:p + 12], ' ') AS s FROM pos),
least AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT win.doc_id, win.p FROM win JOIN least USING (s) WHERE least.m < win.doc_id),
gone AS (SELECT DISTINCT doc_id, p + k AS p FROM hit, (SELECT unnest(range(13)) AS k)),
word AS (SELECT doc_id, w[p] AS x, p FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
