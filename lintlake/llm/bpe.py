"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

The encoding of a prefix ends in exactly one token, and a token ``t`` that is a suffix of the
prefix is that token when it is compatible with the last token of what precedes it: encoding
the two side by side leaves the border between them alone.  A suffix automaton finds the tokens that
end at each byte, the compatible one is stored per prefix, and back-pointers give the ids.

Compatibility is decided on the merge trees.  The tokens that touch the border grow along the
right edge of the left token and the left edge of the right one; merging takes the lowest rank
first, so the border falls when a merge of the two touching pieces has a lower rank than the
merges that consume either piece (at equal rank the leftmost goes first).

The different short pieces of a slice of texts are encoded together, on arrays, one prefix
length after the other; pieces met before are kept.  Long pieces take the same steps one byte
at a time.  Texts with characters that one of two pattern engines does not know are split by the tokenizer
library's own splitter; encoding never calls it.

Null text counts as empty and has no tokens, also very long texts are encoded whole.  Special tokens
in a text become their ids.  Each row has its own result, rows that repeat an id or have none included; an
empty table has no rows, other columns are not read.  The path of the vocabulary file is a parameter; each worker
loads it once.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lintlake.llm.common import table, worker_table

QUERY_NAME = "op6_bpe"
CACHE_PIECES = 100_000
#: Slots of the table of judged pairs of tokens
SLOTS = 1 << 20
#: Pieces of at most so many bytes are encoded many at a time, texts in slices of so many characters
WIDE = 64
SLICE = 1 << 20
ROWS_AT_ONCE = 256
PIECES_AT_ONCE = 1 << 13
#: Fixed value: the split of byte-level tokenizers, as public_tokenizers.PATTERN
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_NEVER = 1 << 40


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabulary files: printable ones for themselves, the others from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


def latin_split() -> re.Pattern:
    """``SPLIT`` with its classes written out, right for texts below U+0250 and faster there."""
    below = [chr(i) for i in range(0x250)]
    letters, numbers, spaces = (re.escape("".join(c for c in below if regex.match(k, c))) for k in (r"\p{L}", r"\p{N}", r"\s"))
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{spaces}{letters}{numbers}]+|[{spaces}]+(?![^{spaces}])|[{spaces}]+")


class _Pieces(dict):
    """Ids of the pieces met before; a full table is kept as the older generation and asked once more."""

    def __init__(self, encode_piece, encode_many):
        self.one, self.many, self.older = encode_piece, encode_many, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            found = self.one(piece.encode())
            ids = struct.pack(f"<{len(found)}I", *found)
        if len(piece) <= WIDE:
            self[piece] = ids
        return ids

    def learn(self, pieces: set[str]) -> None:
        """Encode what is not known yet, all at once."""
        if len(self) >= CACHE_PIECES:
            self.older = dict(self)
            self.clear()
        new = [(p, e) for p in pieces if p not in self and p not in self.older and 0 < len(e := p.encode()) <= WIDE]
        new.sort(key=lambda pair: len(pair[1]))  # pieces of like length make narrow arrays
        for at in range(0, len(new), PIECES_AT_ONCE):
            part = new[at:at + PIECES_AT_ONCE]
            self.update(zip([p for p, _ in part], self.many([e for _, e in part])))


class Codec:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = dict(zip(vocab.values(), vocab)) | {i: s.encode() for s, i in self.special.items()}
        single = {b: vocab[bytes([b])] for b in range(256)}  # every byte is a token, so every prefix has an encoding
        top = max(self.bytes_of) + 1
        self.merge: dict[int, int] = {}  # pair of tokens -> rank
        #: the merge that makes each token: its two parts and its rank; single bytes have none, -2 marks what is never emitted
        self.parts = [array("i", [-2]) * top for _ in range(3)]
        for token in single.values():
            for column in self.parts:
                column[token] = -1
        self.chains: dict[int, list[tuple[int, int]]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = (vocab[bytes(letters[c] for c in part)] for part in (pair if isinstance(pair, list) else pair.split(" ")))
            token = vocab[self.bytes_of[a] + self.bytes_of[b]]
            self.merge[a << 32 | b] = rank
            # a token that plain merging of its own bytes does not give can never be emitted
            first, second, ranks = self.parts
            if first[token] == -2 and first[a] != -2 and first[b] != -2 and self._border(a, b) == (a, b):
                first[token], second[token], ranks[token] = a, b, rank
        self.chains.clear()
        self.table = [self.bytes_of.get(i, b"") for i in range(top)]
        self.sizes = [len(b) for b in self.table]
        self._make_automaton({self.bytes_of[i]: i for i, a in enumerate(self.parts[0]) if a != -2})
        self._make_arrays(top)
        self.judged = np.full(SLOTS, -1)
        self.pieces = _Pieces(self.encode_piece, self.encode_pieces)
        self.split, self.latin, self.beyond = regex.compile(SPLIT), latin_split(), re.compile("[^\\x00-\u024f]")
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.odd: dict[str, bool] = {}
        del self.bytes_of

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """Pieces on the left (0) or right (1) edge of a token, smallest first: token, rank of the merge that consumes it."""
        known = self.chains.get(token << 1 | side)
        if known is None:
            known, at, goes = [], token, _NEVER
            below, ranks = self.parts[side], self.parts[2]
            while at >= 0:
                known.append((at, goes))
                at, goes = below[at], ranks[at]
            known.reverse()
            if len(self.chains) >= CACHE_PIECES:
                self.chains.clear()
            self.chains[token << 1 | side] = known
        return known

    def _border(self, a: int, b: int):
        """The pieces that touch the border of two tokens once each has grown whole, or None if it falls before."""
        right, left = self._edge(a, 1), self._edge(b, 0)
        i = j = 0
        while True:
            (x, x_goes), (y, y_goes) = right[i], left[j]
            if x_goes == y_goes == _NEVER:
                return x, y
            rank = self.merge.get(x << 32 | y)
            if rank is not None and rank < x_goes and rank <= y_goes:
                return None
            if x_goes <= y_goes:
                i += 1
            else:
                j += 1

    def _make_automaton(self, tokens: dict[bytes, int]) -> None:
        """The automaton of all tokens' suffix matches: ``steps`` (state and byte to state), ``ends`` (tokens that end in a state, longest first)."""
        self.steps: dict[int, int] = {}
        self.jumps: dict[int, int] = {}
        own, states = {}, 1
        for token, i in tokens.items():
            at = 0
            for byte in token:
                key = at << 8 | byte
                at = self.steps.get(key, states)
                if at == states:
                    self.steps[key] = at
                    states += 1
            own[at] = i
        self.fall = array("i", [0]) * states  # the state of the longest shorter suffix
        self.ends: list[tuple[int, ...]] = [()] * states
        layer = [(at, 0, key & 255) for key, at in self.steps.items() if key < 256]
        below: dict[int, list[tuple[int, int]]] = {}
        for key, at in self.steps.items():
            below.setdefault(key >> 8, []).append((at, key & 255))
        while layer:
            deeper = []
            for at, parent, byte in layer:
                fall = self._step(self.fall[parent], byte) if parent else 0
                self.fall[at] = fall
                self.ends[at] = (own[at], *self.ends[fall]) if at in own else self.ends[fall]
                deeper += [(child, at, b) for child, b in below.get(at, ())]
            layer = deeper
        self.jumps.clear()

    def _step(self, state: int, byte: int) -> int:
        """Where a byte leads: the state of the longest suffix that some token begins with."""
        key = state << 8 | byte
        to = self.steps.get(key)
        if to is None and state:
            to = self.jumps.get(key)
            if to is None:
                if len(self.jumps) >= 4 * CACHE_PIECES:
                    self.jumps.clear()
                to = self.jumps[key] = self._step(self.fall[state], byte)
        return to or 0

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of one piece of any length."""
        last = [0]  # the last token of each prefix
        state = at = 0
        for byte in piece:
            at += 1
            state = self._step(state, byte)
            for token in self.ends[state]:
                left = at - self.sizes[token]
                if not left or (last[left] << 32 | token not in self.merge and self._border(last[left], token) is not None):
                    break
            last.append(token)
        out = []
        while at:
            out.append(last[at])
            at -= self.sizes[last[at]]
        return out[::-1]

    # --- many pieces at a time: the same steps on arrays, one prefix length after the other ---

    def _make_arrays(self, top: int) -> None:
        self.keys = np.array(sorted(self.steps), np.int64)
        self.targets = np.array([self.steps[k] for k in self.keys.tolist()], np.int64)
        self.falls = np.array(self.fall, np.int64)
        self.size_of = np.array(self.sizes, np.int64)
        self.first_end = np.concatenate([[0], np.cumsum([len(e) for e in self.ends])])
        self.all_ends = np.fromiter((t for e in self.ends for t in e), np.int64)
        pairs = np.array([(k >> 32) << 20 | k & 0xFFFFF for k in self.merge], np.int64)
        order = np.argsort(pairs)
        self.merge_pairs, self.merge_ranks = pairs[order], np.array(list(self.merge.values()), np.int64)[order]
        #: the pieces on the left (0) and right (1) edge of every token, one after the other
        self.edge_first, self.edge_token, self.edge_goes = [], [], []
        for side in (0, 1):
            edges = [self._edge(t, side) if self.parts[0][t] != -2 else [] for t in range(top)]
            self.edge_first.append(np.concatenate([[0], np.cumsum([len(e) for e in edges])]))
            self.edge_token.append(np.fromiter((x for e in edges for x, _ in e), np.int64))
            self.edge_goes.append(np.fromiter((g for e in edges for _, g in e), np.int64))
        self.chains.clear()

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank at which two tokens merge, or more than any."""
        pair = left << 20 | right
        at = np.minimum(np.searchsorted(self.merge_pairs, pair), len(self.merge_pairs) - 1)
        return np.where(self.merge_pairs[at] == pair, self.merge_ranks[at], _NEVER)

    def _steps(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        out = np.zeros(len(state), np.int64)
        open_ = np.arange(len(state))
        while len(open_):
            key = state << 8 | byte
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            out[open_[hit]] = self.targets[at[hit]]
            more = ~hit & (state > 0)
            open_, state, byte = open_[more], self.falls[state[more]], byte[more]
        return out

    def _compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``_border`` for many pairs, with the pairs judged before in a table of fixed size."""
        slot = left * 40503 + right * 1299709 & SLOTS - 1
        pair = left << 20 | right
        known = self.judged[slot]
        new = np.flatnonzero(known >> 1 != pair)
        if len(new):
            fresh, place = np.unique(pair[new], return_inverse=True)
            a, b = fresh >> 20, fresh & 0xFFFFF
            i, j = self.edge_first[1][a], self.edge_first[0][b]
            good = self._ranks(a, b) == _NEVER
            open_ = np.flatnonzero(good)
            while len(open_):
                x_goes, y_goes = self.edge_goes[1][i[open_]], self.edge_goes[0][j[open_]]
                whole = (x_goes == _NEVER) & (y_goes == _NEVER)
                rank = self._ranks(self.edge_token[1][i[open_]], self.edge_token[0][j[open_]])
                falls = ~whole & (rank < x_goes) & (rank <= y_goes)
                good[open_[falls]] = False
                on = ~whole & ~falls
                left_grows = x_goes <= y_goes
                i[open_[on & left_grows]] += 1
                j[open_[on & ~left_grows]] += 1
                open_ = open_[on]
            known[new] = (fresh << 1 | good)[place]
            self.judged[slot[new]] = known[new]
        return (known & 1).astype(bool)

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece as bytes; all are short."""
        sizes = np.array([len(p) for p in pieces])
        order = np.argsort(-sizes, kind="stable")
        sizes = sizes[order]
        width = int(sizes[0])
        text = np.frombuffer(b"".join(pieces[i].ljust(width, b"\0") for i in order), np.uint8).reshape(-1, width).T.astype(np.int64)
        last = np.zeros((width + 1, len(pieces)), np.int64)  # the last token of each prefix
        state = np.zeros(len(pieces), np.int64)
        for at in range(1, width + 1):
            n = int(np.searchsorted(-sizes, -at, "right"))  # so many are long enough
            state = self._steps(state[:n], text[at - 1, :n])
            end = self.first_end[state]
            open_ = np.arange(n)
            while len(open_):
                token = self.all_ends[end[open_]]
                begin = at - self.size_of[token]
                good = begin == 0
                ask = np.flatnonzero(~good)
                good[ask] = self._compatible(last[begin[ask], open_[ask]], token[ask])
                last[at, open_[good]] = token[good]
                open_ = open_[~good]
                end[open_] += 1
        found, at, rows = [], sizes.copy(), np.arange(len(pieces))
        while len(rows):
            token = last[at[rows], rows]
            found.append((rows, token))
            at[rows] -= self.size_of[token]
            rows = rows[at[rows] > 0]
        row = np.concatenate([r for r, _ in found[::-1]])
        ids = np.concatenate([t for _, t in found[::-1]]).astype("<u4")[np.argsort(row, kind="stable")].tobytes()
        ends = (4 * np.cumsum(np.bincount(row, minlength=len(pieces)))).tolist()
        out = [b""] * len(pieces)
        for i, begin, end in zip(order.tolist(), [0, *ends], ends):
            out[i] = ids[begin:end]
        return out

    def _split(self, text: str) -> list[str]:
        if text.isascii() or not self.beyond.search(text):
            return self.latin.findall(text)
        for c in set(text):
            if c not in self.odd:
                self.odd[c] = unicodedata.category(c) == "Cn"
            if self.odd[c]:  # letters newer than one of the two pattern engines: split as the tokenizer's own engine does
                from tokenizers import pre_tokenizers

                level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
                return [text[a:b] for _, (a, b) in level.pre_tokenize_str(text)]
        return self.split.findall(text)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; the different pieces of a slice are encoded together."""
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            stop, size = at, 0
            while stop < len(texts) and size < SLICE:
                size += len(texts[stop])
                stop += 1
            # special tokens stand at the odd places
            cut = [self.cut.split(t) if self.cut is not None and any(s in t for s in self.special) else [t] for t in texts[at:stop]]
            split = [[[p] if k % 2 else self._split(p) for k, p in enumerate(parts)] for parts in cut]
            self.pieces.learn({p for parts in split for plain in parts[::2] for p in plain})
            ids = self.pieces.__getitem__
            out += [b"".join([struct.pack("<I", self.special[x[0]]) if k % 2 else b"".join(map(ids, x)) for k, x in enumerate(parts)]) for parts in split]
            at = stop
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> str:
        table = self.table
        return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


def codec(path: str) -> Codec:
    return worker_table(("codec", path), lambda: Codec(path))


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(text: Column, path: str) -> Column:
    """The ids of a text, as bytes (little-endian unsigned 32-bit integers)."""

    @F.arrow_udf(T.BinaryType())
    def run(texts: pa.Array) -> pa.Array:
        c = codec(path)
        ids = []
        for at in range(0, len(texts), ROWS_AT_ONCE):
            ids += c.encode_all([t or "" for t in texts.slice(at, ROWS_AT_ONCE).to_pylist()])
        return pa.array(ids, pa.binary())

    return run(text)


def decode(ids: Column, path: str) -> Column:
    """The text of ids made by ``encode``; null has none."""

    @F.arrow_udf(T.StringType())
    def run(batch: pa.Array) -> pa.Array:
        c = codec(path)
        return pa.array([c.decode(i.as_py() or b"") for i in batch], pa.string())

    return run(ids)


def encode_decode(text: Column, path: str) -> Column:
    """struct(ids, decoded): as ``encode`` and then ``decode`` of those ids.

    One function for both: of two, the optimizer would run the first again as the second's argument.
    """

    @F.arrow_udf(T.StructType([T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())]))
    def run(texts: pa.Array) -> pa.Array:
        c = codec(path)
        ids, decoded = [], []
        for at in range(0, len(texts), ROWS_AT_ONCE):
            ids += c.encode_all([t or "" for t in texts.slice(at, ROWS_AT_ONCE).to_pylist()])
            decoded.append(pa.array([c.decode(i) for i in ids[at:]], pa.string()))
        return pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.concat_arrays(decoded) if decoded else pa.array([], pa.string())], ["ids", "decoded"])

    return run(text)


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded) of every row of ``docs`` (doc_id, text)."""
    both = encode_decode(F.col("text"), path or vocabulary_path())
    return docs.select("doc_id", both.alias("both")).select("doc_id", "both.ids", "both.decoded")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    return round_trip(docs, path).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


SQL = None
