"""Secret scan: fixed patterns, and values in a credential context that are costly to guess.

Base kinds are found by pattern, leftmost and non-overlapping for each kind:

* ``assign``: a key, ``:`` or ``=``, and a value of six or more characters (span of the whole match),
* ``access``: ``AKIA`` and upper-case letters or digits, twenty or more characters,
* ``hex``: runs of 24 or more lower-case hex digits.

The kind ``guess`` is added for values after a key that is or holds a credential word
(``key: value``, ``key is value``, ``DB_KEY=value``) whose guess cost is high: the smallest sum over all ways to cut the value into common words
(also in leet spelling), dates, repeats, keyboard walks and brute-force spans, found by dynamic
programming.  The span is that of the value.

Spans are code points, end exclusive, ordered by start, then by kind as listed.  Null text has
no spans.  Whole texts are scanned; other columns are not read.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lintlake.llm.common import table

QUERY_NAME = "op3_secrets"
KINDS = ("assign", "access", "hex", "guess")
LEAST_COST = 10.0  # log10 of guesses from which a value counts as a secret

# The base patterns
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")

#: credential words, also within a key such as DB_PASSWORD or authToken; not those that only begin or end another word (author, compass)
_WORD = r"(?:(?<!com)(?<!tres)(?<!sur)pass(?!age|eng|ing|ion|iv|port|over|im)|pwd|secret(?!ar|ion|ly)|token(?!i[sz])|(?:api|private|access)[\x20_.-]?key|credential|login|auth(?!ors?(?![a-z])|ored|oring|orship|oritative|orit(?:y|ies)|entic(?:ity|ally)?(?![a-z])))"
#: a key read once as a whole, what sets it equal, and the value
CONTEXT = re.compile(
    r"""(?ai)(?<![\w.-])(?=[\w.-]*?""" + _WORD + r""")(?:[\w.]|-(?!>))++(?:(?:(?<=api)|(?<=private)|(?<=access))\x20key(?:[\w.]|-(?!>))*+)?["']?\s*+(?::=?|=>?|->|\bis\b)\s*+["']?([^\s"'<>,;]{6,})""")
#: finds every text that any pattern above can match in, in one pass
MAYBE = r"(?i)pass|pwd|secret|token|(?:api|private|access)[ _.-]?key|credential|login|auth|akia|[0-9a-f]{24}"

#: common words and passwords, frequent ones first; the place is the number of guesses
WORDS = (
    "password 123456 qwerty the and for you that with this have from love admin letmein welcome monkey dragon master "
    "login abc123 iloveyou princess sunshine shadow football baseball superman batman hello freedom whatever trustno1 "
    "secret token key test guest user root pass changeme default summer winter spring autumn monday friday january "
    "march april june july august october november december home work house water money happy family mother father "
    "sister brother friend school computer internet server database access security system network office company "
    "black white green blue orange silver gold star moon sun fire earth wind stone river ocean tiger eagle horse "
    "michael jordan daniel thomas robert jessica ashley andrew charlie matthew hunter ranger soccer hockey killer "
    "pepper ginger cookie cheese coffee chocolate banana apple flower angel heaven magic power correct battery staple "
    "required incorrect invalid expired missing wrong needed optional mandatory protected encrypted generated provided disabled enabled unknown"
).split()
RANK = {w: i + 1 for i, w in enumerate(WORDS)}
LONGEST = max(map(len, WORDS))
LEET = str.maketrans("@4301$57!", "aaeoissti")
ROWS = ("`1234567890-=", "\tqwertyuiop[]\\", "\tasdfghjkl;'", "\tzxcvbnm,./")
SHIFTED = str.maketrans('~!@#$%^&*()_+{}|:"<>?', "`1234567890-=[]\\;',./")
NEAR = {
    c: {ROWS[r + dr][k + dk] for dr, dk in ((0, -1), (0, 1), (-1, 0), (-1, 1), (1, -1), (1, 0))
        if 0 <= r + dr < len(ROWS) and 0 <= k + dk < len(ROWS[r + dr])} - {"\t"}
    for r, row in enumerate(ROWS) for k, c in enumerate(row) if c != "\t"
}
DATE = re.compile(r"(?:(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|[12]\d|3[01])\2(?:19|20)?\d\d|(?:19|20)\d\d)")
SEGMENT_COST = 0.3  # each further segment


def _char_cost(c: str) -> float:
    return math.log10(10 if c.isdigit() else 26 if c.isalpha() and c.isascii() else 33 if c.isascii() else 1000)


def _word_cost(part: str) -> float | None:
    low = part.lower()
    rank = RANK.get(low)
    leet = 0.0
    if rank is None:
        rank, leet = RANK.get(low.translate(LEET)), math.log10(4)
    if rank is None:
        return None
    case = 0.0 if part == low else math.log10(2) if part.istitle() or part.isupper() else sum(c.isupper() for c in part) * math.log10(4)
    return math.log10(rank + 1) + leet + case


def guess_cost(value: str, enough: float = math.inf) -> float:
    """log10 of the guesses for ``value``; any number of at least ``enough`` when it is that high."""
    n = len(value)
    best = [0.0] + [math.inf] * n
    plain = value.lower().translate(SHIFTED)
    walk = [0] * n  # length of the keyboard walk that ends here, and its turns
    turns = [0] * n
    for i in range(1, n):
        if plain[i] in NEAR.get(plain[i - 1], ()):
            walk[i] = walk[i - 1] + 1
            turns[i] = turns[i - 1] + (i < 2 or not walk[i - 1] or ord(plain[i]) - ord(plain[i - 1]) != ord(plain[i - 1]) - ord(plain[i - 2]))
    reach = max(LONGEST, 10)
    brute = [0.0] * (n + 1)  # cheapest with a brute-force span that ends here
    brute[0] = math.inf
    for j in range(1, n + 1):
        begin = best[j - 1] + (SEGMENT_COST if j > 1 else 0)
        brute[j] = min(brute[j - 1], begin) + _char_cost(value[j - 1])
        low = brute[j]
        for i in range(max(0, j - reach), j - 2):
            cost = _word_cost(value[i:j])
            if cost is None and j - i <= 10 and DATE.fullmatch(value, i, j):
                cost = math.log10(365 * 100)
            if cost is not None:
                low = min(low, best[i] + cost + (SEGMENT_COST if i else 0))
        if walk[j - 1] >= 2:
            for i in range(j - 1 - walk[j - 1], j - 2):
                if i >= 0 and j - i <= 2 * reach:
                    low = min(low, best[i] + math.log10(47) + (turns[j - 1] - turns[i]) * math.log10(4) + math.log10(j - i) + (SEGMENT_COST if i else 0))
        for unit in range(1, min(reach, j // 2) + 1):  # one more copy of the unit that ends the segment before
            if value[j - unit:j] == value[j - 2 * unit:j - unit]:
                low = min(low, best[j - unit] + math.log10(2) / unit)
        best[j] = low
        if j > reach and min(best[j - reach:j + 1]) >= enough and min(brute[j], low) >= enough:
            return enough
    return best[n]


def scan(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every span."""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    for m in CONTEXT.finditer(text):
        value = m[1].rstrip(".:!?)]}")
        if len(value) >= 6 and guess_cost(value, LEAST_COST) >= LEAST_COST:
            out.append(("guess", m.start(1), m.start(1) + len(value)))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


@F.arrow_udf(SPANS)
def find_spans(texts: pa.Array) -> pa.Array:
    """Spans of each text, ordered."""
    maybe = pc.fill_null(pc.match_substring_regex(texts, MAYBE), False)
    rows = [[{"kind": k, "start": a, "end": b} for k, a, b in scan(t.as_py())] if ok.as_py() else [] for t, ok in zip(texts, maybe)]
    return pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) for every row of ``docs`` (doc_id, text)."""
    return docs.select("doc_id", find_spans("text").alias("spans"))


def _joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return find(table(spark, sf_dir, "documents")).select(
        "doc_id", *map(count, KINDS), F.sha2(_joined(F.filter("spans", lambda s: s.kind != "guess")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


SQL = None
