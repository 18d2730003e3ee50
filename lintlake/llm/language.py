"""Language identification by compression.

Each language has a raw-content zstandard dictionary: the words of a bounded sample of its
labelled documents, rare ones first, so that the frequent ones lie closest to the text.  A text
is compressed in pieces with every dictionary, and the language with the smallest sum wins.
Where the best two are close, a slower search for matches has a second look; if they stay
nearly equal, the document is rejected.

Letters are lower-cased, and runs of ASCII characters that are no letters count as one space.  Null texts
and texts without any letter are ``und`` with score 0 and rejected; so is everything where no
labelled text exists.  Whole texts are read.  Other columns than text are never inputs of a
prediction.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
import zstandard as zs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lintlake.llm.common import table, worker_table

QUERY_NAME = "op2_language"
SAMPLE_DOCS = 200  # labelled documents of a language that its dictionary is made from
SAMPLE_CHARS = 4000  # characters of each of them
DICTIONARY_BYTES = 1 << 17
PIECE = 2048
CLOSE = 0.02  # below this margin a second look
NARROW = 0.002  # below this margin after it: rejected
#: level and changed settings of the first and the second look
LOOKS = ((3, {"strategy": zs.STRATEGY_GREEDY, "min_match": 4}), (12, {}))
UNKNOWN = "und"
_PLAIN = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
RESULT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])


def plain(text: str) -> bytes:
    return b" ".join(text.lower().encode().translate(_PLAIN).split())


def dictionary(texts: list[str], most: int = DICTIONARY_BYTES) -> bytes:
    """The words of the texts, each once, frequent ones last."""
    counts = Counter(w for t in texts for w in plain(t).split())
    out, size = [], 0
    for w in sorted(counts, key=lambda w: (-counts[w], w)):
        size += len(w) + 1
        if size > most:
            break
        out.append(w)
    return b" ".join(out[::-1])


def learn(docs: DataFrame, held_out: Column) -> tuple[tuple[str, bytes], ...]:
    """(language, dictionary) from at most SAMPLE_DOCS labelled rows of each language, chosen by a hash of the id."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out)
    first = Window.partitionBy("lang").orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id", "text")
    rows = rows.select("lang", F.substring("text", 1, SAMPLE_CHARS).alias("text"), "doc_id").withColumn("n", F.row_number().over(first)).where(F.col("n") <= SAMPLE_DOCS)
    texts: dict[str, list[str]] = {}
    for r in rows.select("lang", "text").collect():
        texts.setdefault(r.lang, []).append(r.text)
    return tuple((lang, dictionary(texts[lang])) for lang in sorted(texts))


def _compressors(model: tuple[tuple[str, bytes], ...], look: int) -> list[zs.ZstdCompressor]:
    looks = worker_table(("language", model), dict)
    if look not in looks:
        looks[look] = _made(model, look)
    return looks[look]


def _made(model: tuple[tuple[str, bytes], ...], look: int) -> list[zs.ZstdCompressor]:
    level, changed = LOOKS[look]
    out = []
    for _, words in model:
        how = zs.ZstdCompressionParameters.from_level(
            level, source_size=PIECE, dict_size=len(words), write_content_size=False, write_dict_id=False, **changed)
        d = zs.ZstdCompressionDict(words, dict_type=zs.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=how)
        out.append(zs.ZstdCompressor(dict_data=d, compression_params=how))
    return out


def classify(text: str, model: tuple[tuple[str, bytes], ...]) -> tuple[str, float, bool]:
    """Language, score (share by which the second smallest is larger) and whether the margin is too narrow."""
    data = plain(text)
    pieces = [data[i:i + PIECE] for i in range(0, len(data), PIECE)]
    if len(model) == 1:
        return model[0][0], 1.0, False
    sizes = [0] * len(model)
    for look in range(len(LOOKS)):
        sizes = [s + sum(len(c.compress(p)) for p in pieces) for s, c in zip(sizes, _compressors(model, look))]
        best, second = sorted(sizes)[:2]
        score = 1 - best / max(second, 1)
        if score >= CLOSE:
            break
    return model[sizes.index(best)][0], score, score < NARROW


def predict(text: Column, spark: SparkSession, model: tuple[tuple[str, bytes], ...]) -> Column:
    """A struct column: lang_pred, score, rejected."""
    shared = spark.sparkContext.broadcast(model)  # DICTIONARY_BYTES a language

    @F.arrow_udf(RESULT)
    def run(texts: pa.Array) -> pa.Array:
        m = shared.value
        letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False)
        rows = [classify(t.as_py(), m) if ok.as_py() and m else (UNKNOWN, 0.0, True) for t, ok in zip(texts, letters)]
        lang, score, rejected = zip(*rows) if rows else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], RESULT.fieldNames())

    return run(text)


def held_out(folds: int = 5, fold: int = 0) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of every row of ``docs`` (doc_id, text, lang)."""
    model = learn(docs, held_out())
    found = docs.select("doc_id", held_out().alias("held_out"), predict(F.col("text"), docs.sparkSession, model).alias("p"))
    return found.select("doc_id", "held_out", "p.*")


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language is told with a sufficient margin."""
    model = learn(docs, held_out())
    return docs.withColumn("__language", predict(F.col("text"), docs.sparkSession, model)).where("NOT __language.rejected").drop("__language")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


SQL = None
