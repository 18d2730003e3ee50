"""Documents in packs of a few MB, and a distributed count-min sketch of their windows.

A pack is one row with the ids, offsets and bytes of some documents.  The table of packs is
written once, bucketed by pack, so that facts about a pack's windows found elsewhere join back
without moving the texts again.

The sketch is one row of counters, 4 to 8 per window of the whole input, cut in segments by the
leading bits of the window hash.  Each pack sends its own sketch in sparse form (gaps between
occupied counters, 2 bytes a window); a segment's task adds the packs' sketches up and tells
each pack the merged counts of its own counters.  Counters only overestimate, so a window that
is counted once is alone in the input.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.llm.common import blob, buffers, pow2_at_least, slices, word_bounds, written, written_by

PACK_BYTES = 2 << 20
SEGMENT_WINDOWS = 4 << 20
_PACK_SCHEMA = "pack long, n_docs long, n_words long, ids binary, no_id binary, offs binary, body binary"


def write_packs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A bucketed table of packs; null text counts as empty, null ids are marked in ``no_id``."""

    def pack(batches):
        seq = TaskContext.get().partitionId() << 32
        for part in slices(batches, PACK_BYTES):
            data, offs = buffers(part.column("text"))
            ids = part.column("id")
            starts, _, _ = word_bounds(data, offs)
            yield pa.RecordBatch.from_pydict({
                "pack": pa.array([seq], pa.int64()),
                "n_docs": pa.array([part.num_rows], pa.int64()),
                "n_words": pa.array([len(starts)], pa.int64()),
                "ids": pa.array([blob(ids.fill_null(0).to_numpy(zero_copy_only=False))], pa.binary()),
                "no_id": pa.array([blob(ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8))], pa.binary()),
                "offs": pa.array([blob(offs)], pa.binary()),
                "body": pa.array([data.tobytes()], pa.binary()),
            })
            seq += 1

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return written_by(rows.mapInArrow(pack, _PACK_SCHEMA), "packs", "pack")


def opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, marks of null ids, bytes and offsets of a pack."""
    return (np.frombuffer(row["ids"], np.int64), np.frombuffer(row["no_id"], np.uint8).astype(bool),
            np.frombuffer(row["body"], np.uint8), np.frombuffer(row["offs"], np.int64))


def counters(total_windows: int) -> tuple[int, int]:
    """Bits of a counter's number, and bits of its segment's number."""
    bits = (4 * max(total_windows, 1) - 1).bit_length()
    segment_bits = (pow2_at_least(-(-max(total_windows, 1) // SEGMENT_WINDOWS)) - 1).bit_length()
    return bits, segment_bits


def occupied(hashes: np.ndarray, bits: int):
    """Numbers of a pack's occupied counters in order, the place of each hash among them, and their counts."""
    return np.unique((hashes >> np.uint64(64 - bits)).astype(np.int64), return_inverse=True, return_counts=True)


def _to_gaps(pos: np.ndarray) -> bytes:
    gaps = np.diff(pos, prepend=0)
    many = gaps // 65535
    out = np.full(len(gaps) + int(many.sum()), 65535, np.uint16)
    out[np.cumsum(many + 1) - 1] = gaps % 65535
    return blob(out)


def _from_gaps(data: bytes) -> np.ndarray:
    g = np.frombuffer(data, np.uint16)
    return np.cumsum(g.astype(np.int64))[g != 65535]


def _pieces(pos: np.ndarray, bits: int, segment_bits: int):
    """(segment, slice) of the sorted counter numbers."""
    cuts = np.searchsorted(pos, np.arange((1 << segment_bits) + 1, dtype=np.int64) << (bits - segment_bits))
    for s in np.flatnonzero(np.diff(cuts)):
        yield int(s), slice(int(cuts[s]), int(cuts[s + 1]))


def merged_counts(packs: DataFrame, window_fn, total_windows: int) -> DataFrame:
    """(pack, segment, classes): for each occupied counter of a pack, in order, the class of its merged count.

    ``window_fn(pack row)`` gives the hashes of the pack's windows.  Class 0 is a count of one,
    then 1: 2-3, 2: 4-7, ... 7: 128 and more.
    """
    bits, segment_bits = counters(total_windows)
    width = 1 << (bits - segment_bits)

    def sketch(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                pos, _, counts = occupied(window_fn(row), bits)
                counts = np.minimum(counts, 255).astype(np.uint8)
                cut = list(_pieces(pos, bits, segment_bits))
                yield pa.RecordBatch.from_pydict({
                    "segment": pa.array([s for s, _ in cut], pa.int64()),
                    "pack": pa.array([row["pack"]] * len(cut), pa.int64()),
                    "gaps": pa.array([_to_gaps(pos[p] - s * width) for s, p in cut], pa.binary()),
                    "counts": pa.array([blob(counts[p]) for _, p in cut], pa.binary()),
                })

    def merge(t: pa.Table) -> pa.Table:
        sums = np.zeros(width, np.uint8)
        gaps, counts = t.column("gaps"), t.column("counts")
        for g, c in zip(gaps, counts):
            pos = _from_gaps(g.as_py())
            sums[pos] = np.minimum(sums[pos].astype(np.int16) + np.frombuffer(c.as_py(), np.uint8), 255)
        klass = np.zeros(256, np.uint8)
        klass[1:] = np.log2(np.arange(1, 256)).astype(np.uint8)
        return pa.table({
            "pack": t.column("pack"), "segment": t.column("segment"),
            "classes": pa.array([blob(klass[sums[_from_gaps(g.as_py())]]) for g in gaps], pa.binary()),
        })

    blobs = packs.mapInArrow(sketch, "segment long, pack long, gaps binary, counts binary")
    found = blobs.groupBy("segment").applyInArrow(merge, "pack long, segment long, classes binary")
    return written(found, "counts")


def classes_of(answers: pa.Table) -> np.ndarray:
    """The classes of a pack's occupied counters, in order."""
    if answers.num_rows == 0:
        return np.zeros(0, np.uint8)
    answers = answers.sort_by("segment")
    return np.frombuffer(b"".join(x.as_py() for x in answers.column("classes")), np.uint8)
