"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors of its hashed words, word pairs and character
n-grams; a softmax over two outputs gives the probability of label 1.  Vectors and outputs are
trained with stochastic gradient descent in numpy on a bounded sample of labelled rows.  For
scoring, the difference of the outputs is folded in each vector, so a feature is one number and
a document the mean of its features' numbers.

A pair of equal words has a bucket of its own.  Every whole text is scored; empty and null texts
get the share of label 1 in the sample.  Without usable labels every score is 0.5.  Labels,
language, source and id are never inputs of a score.  Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lintlake.llm.common import _SPACE, buffers, mix, table, word_bounds, word_hashes

QUERY_NAME = "op9_quality"
SAMPLE_ROWS = 4000  # labelled rows that are trained on, chosen by a hash of the id
SAMPLE_CHARS = 4000  # characters of each of them
BITS = 18
DIMS = 8
EPOCHS = 4
RATE = 0.5
SEED = 7
GRAMS = (3, 4)
SLICE_BYTES = 1 << 20
_SHIFT = np.uint32(32 - BITS)


def features(data: np.ndarray, offs: np.ndarray):
    """Arrays of (bucket of each feature, number of the text that it belongs to), one pair for each kind of feature."""
    text = np.where(_SPACE[data], np.uint8(32), data).astype(np.uint32)
    starts, ends, first = word_bounds(data, offs)
    hashes = word_hashes(data, starts, ends)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    yield (hashes >> np.uint64(64 - BITS)).astype(np.int64), doc
    inside = doc[1:] == doc[:-1]
    a, b = hashes[:-1][inside], hashes[1:][inside]
    pairs = np.where(a == b, np.uint64(0), mix(a * np.uint64(3) + b))
    yield (pairs >> np.uint64(64 - BITS)).astype(np.int64), doc[1:][inside]
    owner = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    for n in GRAMS:
        if len(text) < n:
            continue
        key = text[:len(text) - n + 1].copy()
        for k in range(1, n):
            key |= text[k:len(text) - n + 1 + k] << np.uint32(8 * k)
        bucket = ((key ^ (key >> np.uint32(15))) * np.uint32(2654435761 + 2 * n)) >> _SHIFT
        whole = owner[:len(bucket)] == owner[n - 1:]
        yield bucket[whole].astype(np.int64), owner[:len(bucket)][whole]


class Model:
    """One number for each bucket, and the number of a text without features."""

    def __init__(self, weights: np.ndarray, empty: float):
        self.weights, self.empty = weights, empty

    def logits(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        n = len(offs) - 1
        total, count = np.zeros(n), np.zeros(n)
        for bucket, doc in features(data, offs):
            total += np.bincount(doc, weights=self.weights[bucket], minlength=n)
            count += np.bincount(doc, minlength=n)
        return np.where(count > 0, total / np.maximum(count, 1), self.empty)


def train(texts: list[str], labels: list[int]) -> Model:
    """Vectors and outputs by stochastic gradient descent, one document a step, falling rate."""
    share = min(max(sum(labels) / max(len(labels), 1), 1e-3), 1 - 1e-3) if labels else 0.5
    empty = float(np.log(share / (1 - share)))
    if not labels or sum(labels) in (0, len(labels)):
        return Model(np.full(1 << BITS, empty, np.float32), empty)
    rng = np.random.default_rng(SEED)
    vectors = ((rng.random((1 << BITS, DIMS)) - 0.5) / DIMS).astype(np.float32)
    outputs = np.zeros((2, DIMS), np.float32)
    bags = []
    for t in texts:
        data = np.frombuffer(t.encode(), np.uint8)
        bucket = np.concatenate([np.zeros(0, np.int64), *(b for b, _ in features(data, np.array([0, len(data)])))])
        bag, counts = np.unique(bucket, return_counts=True)
        bags.append((bag.astype(np.int32), (counts / max(len(bucket), 1)).astype(np.float32)))
    steps, step = EPOCHS * len(texts), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(texts)):
            rate = RATE * (1 - step / steps)
            step += 1
            bag, w = bags[i]
            if not len(bag):
                continue
            hidden = w @ vectors[bag]
            z = outputs @ hidden
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = rate * (p @ outputs)
            outputs -= rate * np.outer(p, hidden)
            # every feature takes the same share, as the average's gradient does before division
            vectors[bag] -= back * (w * len(bag))[:, None]
    return Model(vectors @ (outputs[1] - outputs[0]), empty)


def learn(docs: DataFrame, labels: DataFrame, held_out: Column, label: str = "quality") -> Model:
    """The model of at most SAMPLE_ROWS labelled rows that are not held out."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out).groupBy("doc_id").agg(F.max(label).alias("label"))
    chosen = known.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(SAMPLE_ROWS)
    rows = docs.select("doc_id", F.substring(F.coalesce("text", F.lit("")), 1, SAMPLE_CHARS).alias("text")).join(
        F.broadcast(chosen), "doc_id")  # SAMPLE_ROWS rows
    # rows that repeat a doc_id may be more than the sample
    sample = sorted((r.doc_id, r.text, r.label) for r in rows.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id", "text").limit(SAMPLE_ROWS).collect())
    return train([t for _, t, _ in sample], [int(y) for _, _, y in sample])


def score(text: Column, spark: SparkSession, model: Model) -> Column:
    """Probability of label 1."""
    shared = spark.sparkContext.broadcast((model.weights, model.empty))  # 1 MB

    @F.arrow_udf(T.DoubleType())
    def run(texts: pa.Array) -> pa.Array:
        m = Model(*shared.value)
        sizes = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        out, at = [np.zeros(0)], 0
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE_BYTES, "right")))
            out.append(m.logits(*buffers(texts.slice(at, stop - at))))
            at = stop
        return pa.array(1 / (1 + np.exp(-np.clip(np.concatenate(out), -500, 500))))

    return run(text)


def held_out(folds: int = 3, fold: int = 1) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def rate_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs`` (doc_id, text)."""
    model = learn(docs, labels, held_out())
    found = docs.select("doc_id", held_out().alias("held_out"), score(F.col("text").cast("binary"), docs.sparkSession, model).alias("score"))
    return found.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rate_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL = None
