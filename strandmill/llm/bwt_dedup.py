"""Removal of repeated passages, by merging sorted shards of a sparse suffix index.

A window of `length` bytes is repeated if it starts anywhere else too. The suffixes that are indexed are those at anchors:
each window's anchor is the place of the least hashed 16-byte gram in it (the leftmost of equal ones), which depends on the
window's bytes alone, so that two equal windows have equal anchors at equal offsets. Windows with the same anchor form a
segment, about 590 bytes long, that is shuffled by the anchor's hash. Each map batch is a shard: its segments are unique
(copies become a count and a list of places) and in suffix order.

A reducer merges its shards by interleave refinement. All suffixes with one anchor start as one block, shard after shard;
each round splits the blocks by the next symbol, stably, so that the shards' own orders are kept and no suffixes are
compared with each other, and blocks of one suffix are settled. The round in which two neighbours part is their common prefix.
The same is done leftwards over the Burrows-Wheeler columns (the symbols that precede the suffixes). A window at
offset a before its anchor is then repeated if another suffix shares `length - a` symbols rightwards and a leftwards:
block numbers at any depth are running counts of short common prefixes.

Only anchors are indexed, as refining all suffixes for 400 rounds takes hours of CPU time a GB; results are exact all the same.

For the pipeline a text is the four-byte codes of its words, so that a window of WORDS words is one of 4 * WORDS bytes; of the
starts found, those at the first byte of a code count. There a passage goes that two documents hold, not one that a single one repeats.

Defined cases: a null text is empty; a text shorter than the window has nothing removed unless it is covered from
elsewhere, which it can't be. Repeated rows count as two documents, each of which makes the other repeated. An empty
table gives an empty result. Texts of any length are cut into overlapping pieces, which changes no result. Equal windows are
all removed, the first included. Other columns are ignored, whatever their names, and kept by `strip` and `strip_words`.
"""

from __future__ import annotations

import hashlib
import pickle
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import Scratch, columns, partition_keys, text_or_empty, unused

LENGTH, GRAM = 400, 16
#: A passage of over 50 words, and the bytes of a word's code.
WORDS, CODE = 51, 4
BATCH_BYTES, PIECE_BYTES, POSITION_BITS = 1 << 22, 1 << 22, 24
#: Bytes of segments (3.1 for each byte of text) that a reducer gets on average.
REDUCER_BYTES = 48_000_000
C1, C2, C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def plain_bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def word_codes(text: str) -> bytes:
    parts = plain_bytes(text).split()
    return np.fromiter(map(zlib.crc32, parts), "<u4", len(parts)).tobytes()


def gram_hashes(buf: bytes) -> np.ndarray:
    """A 64-bit hash of the 16 bytes from each place on."""
    n = len(buf) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    word = np.ndarray((n + 8,), "<u8", buf, strides=(1,))
    with np.errstate(over="ignore"):
        h = word[:n] * C1
        h ^= h >> np.uint64(29)
        h += word[8:] * C2
        h *= C3
        h ^= h >> np.uint64(32)
        h *= C1
        h ^= h >> np.uint64(29)
    return h


def segments(pieces: list[bytes], length: int = LENGTH) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The joined pieces; for each segment its first and last window start, its anchor, and the anchor's hash."""
    buf = b"".join(pieces)
    h = gram_hashes(buf)
    width = length - GRAM + 1
    empty = np.zeros(0, np.int64)
    if len(h) < width:
        return buf, empty, empty, empty, np.zeros(0, np.uint64)
    key = (h & ~np.uint64((1 << POSITION_BITS) - 1)) | np.arange(len(h), dtype=np.uint64)
    span = 1
    while 2 * span <= width:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    if width > span:
        key = np.minimum(key[: len(key) - (width - span)], key[width - span :])
    anchor = (key & np.uint64((1 << POSITION_BITS) - 1)).astype(np.int64)
    at, valid = 0, np.zeros(len(anchor), bool)
    for p in pieces:
        if len(p) >= length:
            valid[at : at + len(p) - length + 1] = True
        at += len(p)
    start = np.flatnonzero(valid)
    if not len(start):
        return buf, empty, empty, empty, np.zeros(0, np.uint64)
    a = anchor[start]
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (start[1:] != start[:-1] + 1)))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    return buf, start[first], start[last], a[first], h[a[first]]


def _pieces(text: bytes, length: int) -> Iterator[tuple[int, bytes]]:
    if len(text) <= PIECE_BYTES:
        yield 0, text
        return
    for at in range(0, len(text) - length + 1, PIECE_BYTES - length + 1):
        yield at, text[at : at + PIECE_BYTES]


def _shard(docs: list[tuple[int, int, int, bytes]], reducers: int, length: int) -> tuple[list[int], list[bytes]]:
    """Blobs of one batch of (k1, k2, offset, piece), by reducer."""
    buf, first, last, anchor, h = segments([d[3] for d in docs], length)
    bound = np.cumsum([len(d[3]) for d in docs])
    owner = np.searchsorted(bound, first, side="right")
    base = bound - [len(d[3]) for d in docs] - [d[2] for d in docs]
    place = first - base[owner]
    route = (h >> np.uint64(20)) % np.uint64(reducers)
    offset, starts = (anchor - first).tolist(), (last - first + 1).tolist()
    lo, hi = first.tolist(), (last + length).tolist()
    by_route = np.argsort(route, kind="stable")
    cuts = np.flatnonzero(np.concatenate(([True], route[by_route][1:] != route[by_route][:-1]))) if len(h) else []
    routes, blobs = [], []
    keys = np.array([d[:2] for d in docs], np.int64).reshape(-1, 2)
    squeeze = zstandard.ZstdCompressor(level=1)
    for k, cut in enumerate(cuts):
        own = by_route[cut : cuts[k + 1] if k + 1 < len(cuts) else None]
        unique: dict[tuple[bytes, int, int], list[int]] = {}
        for j in own.tolist():
            unique.setdefault((buf[lo[j] : hi[j]], offset[j], starts[j]), []).append(j)
        order = sorted(unique, key=lambda u: u[0][u[1] :])  # the shard's suffix order
        refs = [unique[u] for u in order]
        flat = np.array([j for r in refs for j in r], np.int64)
        used, doc = np.unique(owner[flat], return_inverse=True)
        blob = (np.array([h[r[0]] for r in refs], np.uint64), [u[0] for u in order], [u[1] for u in order], [u[2] for u in order], [len(r) for r in refs], keys[used], doc.astype(np.int32), place[flat])
        routes.append(int(route[own[0]]))
        blobs.append(squeeze.compress(pickle.dumps(blob, 5)))
    return routes, blobs


def _map(batches: Iterator[pa.RecordBatch], keys: np.ndarray, length: int, encode: Callable[[str], bytes] = plain_bytes) -> Iterator[pa.RecordBatch]:
    held: list[tuple[int, int, int, bytes]] = []
    size = 0

    def flush() -> pa.RecordBatch:
        routes, blobs = _shard(held, len(keys), length)
        return pa.RecordBatch.from_arrays([pa.array(keys[routes], pa.int32()), pa.array(blobs, pa.binary())], ["reducer", "blob"])

    for b in batches:
        for k1, k2, text in zip(b.column("k1").to_pylist(), b.column("k2").to_pylist(), b.column("text"), strict=True):
            data = encode(text.as_py())
            if len(data) < length:
                continue
            for at, piece in _pieces(data, length):
                held.append((k1, k2, at, piece))
                size += len(piece)
                if size >= BATCH_BYTES:
                    yield flush()
                    held.clear()
                    size = 0
    if held:
        yield flush()


def refine(block: np.ndarray, column: np.ndarray, lengths: np.ndarray, at: np.ndarray, data: np.ndarray, step: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave refinement to `depth`. block: sorted block numbers of suffixes in shard order; suffix column[i] has its
    symbol t at data[at + step * t] for t < lengths. Gives the merged order (indices) and, for each place, the common
    prefix with the place before it (-1 at the start of a first block)."""
    n = len(block)
    order = np.arange(n)
    common = np.where(np.concatenate(([True], block[1:] != block[:-1])), -1, depth).astype(np.int32)
    live = np.flatnonzero(~((common < depth) & np.concatenate((common[1:] < depth, [True]))))
    for t in range(depth):
        if not len(live):
            break
        here = order[live]
        suffix = column[here]
        symbol = np.where(t < lengths[suffix], data[np.minimum(np.maximum(at[suffix] + step * t, 0), len(data) - 1)].astype(np.int16), -1).astype(np.int16)
        part = np.cumsum(common[live] < depth)  # numbers of the live blocks
        same = np.concatenate(([False], part[1:] == part[:-1]))
        mixed = same & (symbol != np.concatenate(([np.int16(0)], symbol[:-1])))
        if mixed.any():
            sort = np.argsort(part.astype(np.int64) * 512 + symbol + 1, kind="stable")
            order[live] = here[sort]
            symbol = symbol[sort]
            split = same & (symbol != np.concatenate(([np.int16(0)], symbol[:-1])))
            common[live[split]] = t
            low = common[live] < depth
            live = live[~(low & np.concatenate((low[1:], [True])))]
    return order, common


def repeated_starts(text: list[bytes], offset: np.ndarray, starts: np.ndarray, low: np.ndarray, high: np.ndarray, group: np.ndarray, length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For each unique segment, the runs (first, last) of window starts, from the segment's first byte on, that are
    repeated: that occur at two places at least. low and high: the first and last of a segment's places, in any numbering.
    Segments with one anchor hash have one group number; groups are consecutive."""
    n = len(text)
    data = np.frombuffer(b"".join(text) + b"\0", np.uint8)
    size = np.array([len(x) for x in text], np.int64)
    begin = np.cumsum(size) - size
    every = np.arange(n)
    most = length - GRAM
    right, right_common = refine(group, every, size - offset, begin + offset, data, 1, length)
    left, left_common = refine(group, every, offset, begin + offset - 1, data, -1, most)
    right_place, left_place = np.empty(n, np.int64), np.empty(n, np.int64)
    right_place[right], left_place[left] = every, every
    hit = np.zeros((n, most + 1), bool)
    lowest = offset - starts + 1
    for a in range(most + 1):
        own = np.flatnonzero((lowest <= a) & (a <= offset))
        if not len(own):
            continue
        r = np.cumsum(right_common < length - a)[right_place[own]]
        x = np.cumsum(left_common < a)[left_place[own]]
        key = r * (n + 1) + x
        sort = np.argsort(key, kind="stable")
        key = key[sort]
        new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        twice = np.minimum.reduceat(low[own][sort], new) < np.maximum.reduceat(high[own][sort], new)
        hit[own[sort[np.repeat(twice, np.diff(np.append(new, len(key))))]], a] = True
    out: list[list[tuple[int, int]]] = []
    for i in range(n):
        row = hit[i, lowest[i] : offset[i] + 1][::-1]  # by start: offset a is start offset - a
        edge = np.flatnonzero(np.diff(np.concatenate(([0], row.view(np.int8), [0]))))
        out.append(list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist(), strict=True)))
    return out


def _reduce(batches: Iterator[pa.RecordBatch], length: int, across: bool = False) -> Iterator[pa.RecordBatch]:
    """across: only what two different rows (by their hashes) hold is repeated, else any two places."""
    shards = []
    expand = zstandard.ZstdDecompressor()
    hashes = []
    for b in batches:
        for blob in b.column("blob"):
            shards.append(blob.as_py())
            hashes.append(pickle.loads(expand.decompress(shards[-1]))[0])
    if not shards:
        return
    # First the anchors that occur more than once; the segments of the others are dropped as they are read.
    flat = np.concatenate(hashes)
    counts = np.concatenate([np.array(pickle.loads(expand.decompress(s))[4], np.int64) for s in shards])
    order = np.argsort(flat, kind="stable")
    new = np.flatnonzero(np.concatenate(([True], flat[order][1:] != flat[order][:-1]))) if len(flat) else np.zeros(0, np.int64)
    wanted = flat[order][new][np.add.reduceat(counts[order], new) >= 2] if len(flat) else flat
    unique: dict[tuple[int, bytes, int, int], int] = {}
    refs: list[list[tuple[np.ndarray, int]]] = []
    while shards:
        h, text, offset, starts, number, keys, doc, place = pickle.loads(expand.decompress(shards.pop(0)))
        keep = np.isin(h, wanted)
        ends = np.cumsum(number)
        for j in np.flatnonzero(keep).tolist():
            i = unique.setdefault((int(h[j]), text[j], offset[j], starts[j]), len(refs))
            if i == len(refs):
                refs.append([])
            refs[i] += [(keys[doc[k]], int(place[k])) for k in range(ends[j] - number[j], ends[j])]
    rows = sorted(unique.items(), key=lambda x: x[0][0])  # stable: groups in shard order
    found: dict[tuple[int, int], tuple[list[int], list[int]]] = {}
    if across:
        low, high = (np.array([f(int(key[0]) for key, _ in own) for own in refs], np.int64) for f in (min, max))
    else:
        high = np.cumsum([len(own) for own in refs])
        low = high - [len(own) for own in refs] + 1
    at = 0
    while at < len(rows):
        end = min(len(rows), at + 20_000)
        while end < len(rows) and rows[end][0][0] == rows[end - 1][0][0]:
            end += 1
        part = rows[at:end]
        at = end
        which = np.array([i for _, i in part])
        group = np.unique(np.array([k[0] for k, _ in part], np.uint64), return_inverse=True)[1]
        runs = repeated_starts([k[1] for k, _ in part], np.array([k[2] for k, _ in part]), np.array([k[3] for k, _ in part]), low[which], high[which], group, length)
        for (_, i), own in zip(part, runs, strict=True):
            for key, place in refs[i] if own else ():
                got = found.setdefault((int(key[0]), int(key[1])), ([], []))
                got[0].extend(place + x for x, _ in own)
                got[1].extend(place + y + length for _, y in own)
    if found:
        keys = np.array(list(found), np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array([x for x, _ in found.values()], pa.list_(pa.int64())), pa.array([y for _, y in found.values()], pa.list_(pa.int64()))],
            ["k1", "k2", "first", "past"],
        )


OWN = ("_k1", "_k2", "_first", "_past")


def repeated_passages(docs: DataFrame, length: int = LENGTH, encode: Callable[[str], bytes] = plain_bytes, across: bool = False) -> DataFrame:
    """The documents with the columns that unused(docs, *OWN) names: two hashes that name a row by its id and text (equal rows share them, and
    count as often as they occur), and starts and ends of byte ranges (of what encode makes of the texts) to remove, of which some overlap; null if none."""
    if not GRAM <= length <= 1 << POSITION_BITS:
        raise ValueError(f"length must be at least {GRAM}")
    k1, k2, first, past = unused(docs, *OWN)
    whole = text_or_empty()
    keyed = docs.withColumns({k1: F.xxhash64("doc_id", whole), k2: F.xxhash64(whole, F.lit(17), F.col("doc_id"))})
    text = keyed.select(F.col(k1).alias("k1"), F.col(k2).alias("k2"), whole.alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    reducers = max(6, int(3.1 * total / REDUCER_BYTES) + 1)
    keys = partition_keys(reducers)
    shards = text.mapInArrow(lambda x: _map(x, keys, length, encode), "reducer int, blob binary")
    spans = shards.repartition(reducers, "reducer").mapInArrow(lambda x: _reduce(x, length, across), "k1 long, k2 long, first array<long>, past array<long>")
    by_doc = spans.groupBy(F.col("k1").alias(k1), F.col("k2").alias(k2)).agg(F.flatten(F.collect_list("first")).alias(first), F.flatten(F.collect_list("past")).alias(past))
    found = Scratch(docs.sparkSession).write(by_doc)
    return keyed.join(found, [k1, k2], "left")


def merged(first: list[int] | None, past: list[int] | None) -> list[tuple[int, int]]:
    """Maximal ranges."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(first or (), past or (), strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def without(data: bytes, ranges: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for a, b in ranges:
        parts.append(data[at:a])
        at = b
    return b"".join([*parts, data[at:]])


def digest(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t, x, y in zip(b.column("text"), b.column("_first"), b.column("_past"), strict=True):
                data = t.as_py().encode("utf-8", "surrogatepass")
                ranges = merged(x.as_py(), y.as_py())
                rows.append((len(data), sum(q - p for p, q in ranges), len(ranges), hashlib.sha256(without(data, ranges)).hexdigest()))
            cols = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    found = repeated_passages(docs.select("doc_id", "text"), length).select("doc_id", text_or_empty().alias("text"), "_first", "_past")
    return found.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _stripped(found: DataFrame, docs: DataFrame, ranges: Callable[[bytes, list[int] | None, list[int] | None], list[tuple[int, int]]]) -> DataFrame:
    """The rows go along as structs, so that their columns can have any names and types."""
    _, _, first, past = unused(docs, *OWN)
    others = [c for c, name in zip(columns(docs), docs.columns, strict=True) if name != "text"]
    packed = found.select(F.struct(*others).alias("row"), "text", F.col(first).alias("first"), F.col(past).alias("past"))

    def one(text: str | None, first: list[int] | None, past: list[int] | None) -> str | None:
        if text is None or not first:
            return text
        data = plain_bytes(text)
        return without(data, ranges(data, first, past)).decode("utf-8", "ignore")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [one(t.as_py(), x.as_py(), y.as_py()) for t, x, y in zip(b.column("text"), b.column("first"), b.column("past"), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(texts, pa.string())], ["row", "text"])

    schema = StructType([StructField("row", packed.schema["row"].dataType), StructField("text", StringType())])
    return packed.mapInArrow(run, schema).select(*[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def strip(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents, with their own columns, without the repeated bytes of their texts. Characters cut in two at the edge of a range go whole. A null text stays null."""
    return _stripped(repeated_passages(docs, length), docs, lambda _, first, past: merged(first, past))


def word_ranges(data: bytes, first: list[int] | None, past: list[int] | None, words: int = WORDS) -> list[tuple[int, int]]:
    """The byte ranges, each from the first byte of a word to the last of one, of ranges of codes."""
    starts = [(-(-a // CODE), b // CODE - words) for a, b in zip(first or (), past or (), strict=True)]
    whole = merged(*zip(*[(a, b + words) for a, b in starts if a <= b], strict=True)) if any(a <= b for a, b in starts) else []
    if not whole:
        return []
    place = [m.span() for m in re.finditer(rb"\S+", data)]
    return [(place[a][0], place[b - 1][1]) for a, b in whole]


def strip_words(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """As strip(), for each passage of at least `words` words that another document holds too, whatever its bytes and the white space in it.
    Rows of equal doc_id and text are one document."""
    return _stripped(repeated_passages(docs, CODE * words, word_codes, across=True), docs, lambda data, first, past: word_ranges(data, first, past, words))
