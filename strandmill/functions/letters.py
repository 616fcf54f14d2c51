"""Characters of texts in Arrow batches, as NumPy arrays: for what would need a row, or an interpreted step, a character in Spark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of text looked at together (one longer text counts as one), and cells of counts held by a task before they are handed on.
PIECE, CELLS = 1 << 22, 1 << 22


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, and where each text starts, and the last ends; a null is empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = np.dtype(np.int64 if pa.types.is_large_string(texts.type) else np.int32)
    _, bounds, data = texts.buffers()
    bounds = np.frombuffer(bounds, wide, len(texts) + 1, texts.offset * wide.itemsize).astype(np.int64)
    return np.frombuffer(data or b"", np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def _starts(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes begin a character, and the bounds counted in characters."""
    first = (raw & 0xC0) != 0x80
    return first, np.concatenate(([0], np.cumsum(first)))[bounds]


def characters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, one after another, and where each text starts, and the last ends."""
    raw, bounds = _bytes(texts)
    if not raw.size or raw.max() < 0x80:
        return raw, bounds
    codes = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    starts = _starts(raw, bounds)[1]
    if codes.size == starts[-1]:
        return codes, starts
    each = [raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(bounds[:-1], bounds[1:], strict=True)]  # not UTF-8
    return np.frombuffer("".join(each).encode("utf-32-le"), np.uint32), np.concatenate(([0], np.cumsum([len(t) for t in each], dtype=np.int64)))


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of at most PIECE bytes of text, or of one row."""
    ends = np.cumsum(sum(pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE, "right")))
        yield batch.slice(at, to - at)
        at = to


def mapped(text: Column, table: bytes) -> Column:
    """The text with each character put by that of the table's 256 at its code, and by the last one beyond ASCII. All of the table is ASCII."""

    @F.arrow_udf("string")
    def put(texts: pa.Array) -> pa.Array:
        letters, out = np.frombuffer(table[:128] + table[-1:] * 128, np.uint8), []
        for part in pieces(pa.RecordBatch.from_arrays([texts], ["text"])):
            raw, bounds = _bytes(part.column(0))
            if raw.size and raw.max() >= 0x80:
                first, bounds = _starts(raw, bounds)
                raw = raw[first]
            out.append(pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(letters[raw])))
        made = pa.concat_arrays(out) if out else pa.array([], pa.string())
        return pc.if_else(texts.is_valid(), made, pa.scalar(None, pa.string())) if texts.null_count else made

    return put(text)


def _kinds(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if codes.dtype != np.uint8:
        return np.unique(codes, return_inverse=True)
    kinds = np.flatnonzero(np.bincount(codes, minlength=256))
    number = np.zeros(256, np.int64)
    number[kinds] = np.arange(kinds.size)
    return kinds, number[codes]


PLACES = "pos int, c string, n long"


def count_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """pos (1-based), c, n of the only column. Counts of one place and character can come in several rows."""

    def rows(pos: np.ndarray, codes: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        kinds, which = np.unique(codes, return_inverse=True)
        return pa.RecordBatch.from_arrays([pa.array(pos + 1, pa.int32()), pa.array([chr(k) for k in kinds], pa.string()).take(pa.array(which)), pa.array(n, pa.int64())], ["pos", "c", "n"])

    def held() -> pa.RecordBatch:
        at = [np.flatnonzero(n) for n in counts.values()]
        return rows(np.concatenate(at), np.repeat(list(counts), [a.size for a in at]), np.concatenate([n[a] for n, a in zip(counts.values(), at, strict=True)]))

    counts: dict[int, np.ndarray] = {}
    for batch in batches:
        for piece in pieces(batch):
            codes, starts = characters(piece.column(0))
            if not codes.size:
                continue
            sizes = np.diff(starts)
            pos = np.arange(codes.size) - np.repeat(starts[:-1], sizes)
            kinds, which = _kinds(codes)
            longest = int(sizes.max())
            key = pos * kinds.size + which
            if longest * kinds.size > CELLS:  # a long text, or of a large alphabet
                key, n = np.unique(key, return_counts=True)
                yield rows(key // kinds.size, kinds[key % kinds.size], n)
                continue
            for code, n in zip(kinds.tolist(), np.bincount(key, minlength=longest * kinds.size).reshape(longest, kinds.size).T, strict=True):
                old = counts.get(code, n[:0])
                total = np.zeros(max(old.size, n.size), np.int64)
                total[: old.size] += old
                total[: n.size] += n
                counts[code] = total
            if sum(n.size for n in counts.values()) > CELLS:
                yield held()
                counts.clear()
    if counts:
        yield held()


READS = "len int, tlen int, gc int, avgq int, n long"


def count_reads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """len, tlen (as truncated_length), gc (G and C within tlen), avgq (whole mean of the quality's codes, null without), n of (sequence, quality)."""
    for batch in batches:
        for piece in pieces(batch):
            codes, starts = characters(piece.column(0))
            size, none = np.diff(starts), piece.column(0).is_null().to_numpy(zero_copy_only=False)
            tlen = np.where(size > 1000, size // 1000 * 1000, np.where(size > 100, size // 100 * 100, size))
            gc = np.concatenate(([0], np.cumsum((codes == ord("G")) | (codes == ord("C")))))
            gc = gc[starts[:-1] + tlen] - gc[starts[:-1]]
            codes, starts = characters(piece.column(1))
            total, of = np.concatenate(([0], np.cumsum(codes, dtype=np.int64))), np.diff(starts)
            avgq = (total[starts[1:]] - total[starts[:-1]]) // np.maximum(of, 1)
            found = pa.table({"len": pa.array(size, pa.int32(), mask=none), "tlen": pa.array(tlen, pa.int32(), mask=none), "gc": pa.array(gc, pa.int32(), mask=none), "avgq": pa.array(avgq, pa.int32(), mask=of == 0)})
            n = found.group_by(found.column_names).aggregate([([], "count_all")]).rename_columns({"count_all": "n"}).select([*found.column_names, "n"])
            yield from n.to_batches()
