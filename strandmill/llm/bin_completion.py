"""Best-fit packing of token sequences by bin completion.

Texts are tokenised, closed with the end id and cut into pieces of at most `capacity` tokens. Pieces are dealt by hash to
shards of about `PER_SHARD`, each of which is packed by one task: some hundred thousandths of all sequences are lost at
shard ends, and no task depends on the size of the whole. Within a shard only the number of pieces of each length counts.
Bins are completed around the largest remaining piece by all undominated fillings, of any number of pieces, least waste first. A
filling is dominated, and not tried, if a piece outside it is as large as some of its pieces together, or larger by no more than the
room that is left: that piece could stand in for them. The best-fit-decreasing packing is the first incumbent, and each better packing
found the next; a branch ends when its waste exceeds what a packing with one bin less may waste, and the search ends when the
incumbent meets the lower bound, or all is searched, or `NODES` fillings were looked at (bin packing is NP-hard; what is cut
short then is the proof, and every piece is packed all the same).

Ids are those of the tokenizers file; they are computed with tiktoken from the same vocabulary, six times as fast, except for texts
that hold the special token's string, or that its pattern matcher gives up on (very long runs of blanks), which go through tokenizers itself.

Defined cases: a null or empty text is the end id alone. Repeated rows are packed each; of pieces of one length any may take a place.
An empty table gives an empty result. A text of any length is cut; every piece but the first is full. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, text_or_empty

CAPACITY, END_ID = 2048, 0
PER_SHARD, NODES = 20_000, 10_000
SPECIAL = "<|endoftext|>"


@lru_cache(2)
def encoder(ranks_file: str, json_file: str, pattern: str):
    """A function from text to ids (uint32)."""
    import tiktoken

    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    slow: list = []

    def by_tokenizers(text: str) -> np.ndarray:
        if not slow:
            from tokenizers import Tokenizer

            slow.append(Tokenizer.from_file(json_file))
        return np.array(slow[0].encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(text: str) -> np.ndarray:
        if SPECIAL in text:
            return by_tokenizers(text)
        try:
            return fast.encode_to_numpy(text, disallowed_special=()).astype(np.uint32, copy=False)
        except ValueError:  # its matcher's stack has a limit
            return by_tokenizers(text)

    return encode


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first may be shorter than the capacity."""
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first), *[(s, capacity) for s in range(first, n, capacity)]]


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: tuple[str, str, str] | None = None) -> DataFrame:
    """doc_id, uid, piece, start, length, ids_crc32. tokenizer: paths of the ranks and json files, and the split pattern."""
    if tokenizer is None:
        import public_tokenizers as tok

        tokenizer = tok.path("byte_bpe_50k.tiktoken"), tok.path("byte_bpe_50k.json"), tok.PATTERN
    files = tuple(map(str, tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(*files)
        for b in batches:
            at, rows = [], []
            for i, text in enumerate(b.column("text")):
                ids = np.append(encode(text.as_py()), np.uint32(END_ID)).astype("<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    at.append(i)
                    rows.append((k, start, length, zlib.crc32(ids[start : start + length])))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 4
            taken = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(taken), b.column("uid").take(taken), pa.array(cols[0], pa.int32()), *[pa.array(c, pa.int64()) for c in cols[1:]]],
                ["doc_id", "uid", "piece", "start", "length", "ids_crc32"],
            )

    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("uid"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, uid long, piece int, start long, length long, ids_crc32 long")


def least_bins(counts: np.ndarray) -> int:
    """Martello and Toth's bound: pieces over half the capacity can't share; what doesn't fit beside them needs bins of its own."""
    cap = len(counts) - 1
    number = np.concatenate(([0], np.cumsum(counts)))
    weight = np.concatenate(([0], np.cumsum(counts * np.arange(cap + 1))))
    half = cap // 2
    best = -(-int(weight[-1]) // cap)
    large = int(number[-1] - number[half + 1])
    for k in range(half + 1):
        beside = int(number[cap - k + 1] - number[half + 1])
        room = beside * cap - int(weight[cap - k + 1] - weight[half + 1])
        small = int(weight[half + 1] - weight[k])
        best = max(best, large + max(0, -(-(small - room) // cap)))
    return best


def best_fit(counts: np.ndarray) -> list[tuple[int, ...]]:
    cap = len(counts) - 1
    open_: dict[int, list[list[int]]] = defaultdict(list)
    mask, bins = 0, []
    for length in range(cap, 0, -1):
        for _ in range(int(counts[length])):
            fits = mask >> length
            if fits:
                room = length + (fits & -fits).bit_length() - 1
                own = open_[room].pop()
                if not open_[room]:
                    mask &= ~(1 << room)
            else:
                room, own = cap, []
                bins.append(own)
            own.append(length)
            if room > length:
                open_[room - length].append(own)
                mask |= 1 << room - length
    return [tuple(b) for b in bins]


class _Stock:
    """How many pieces of each length remain, with their lengths as the bits of a number, and of its mirror image."""

    def __init__(self, counts: np.ndarray):
        self.cap, self.count = len(counts) - 1, counts.tolist()
        self.bits = sum(1 << i for i, n in enumerate(self.count) if n)
        self.mirror = sum(1 << self.cap - i for i, n in enumerate(self.count) if n)
        self.left = sum(self.count)

    def take(self, lengths: tuple[int, ...]) -> None:
        for x in lengths:
            self.count[x] -= 1
            if not self.count[x]:
                self.bits ^= 1 << x
                self.mirror ^= 1 << self.cap - x
        self.left -= len(lengths)

    def sums(self, most: int) -> int:
        """The totals up to `most` that some of the pieces have, as bits."""
        mask, reach = (2 << most) - 1, 1
        rest = self.bits & mask & ~1
        while rest and reach != mask:
            x = rest.bit_length() - 1
            rest ^= 1 << x
            for _ in range(min(self.count[x], most // x)):
                before = reach
                reach |= reach << x & mask
                if reach == before:
                    break
        return reach

    def put(self, lengths: tuple[int, ...]) -> None:
        for x in lengths:
            if not self.count[x]:
                self.bits ^= 1 << x
                self.mirror ^= 1 << self.cap - x
            self.count[x] += 1
        self.left += len(lengths)


def _spread(bits: int, most: int) -> int:
    """Each set bit also at the next `most` places up."""
    done = 0
    while done < most:
        step = min(done + 1, most - done)
        bits |= bits << step
        done += step
    return bits


def dominated(filling: tuple[int, ...], slack: int, others: int) -> bool:
    """Whether a piece outside the filling (others: their lengths as bits) could take the place of some of its pieces: of one that is smaller,
    or of several that are together no larger, by at most the slack."""
    one = more = 0
    for x in filling:
        more |= (more << x) | (one << x)
        one |= 1 << x
    return bool(others & (_spread(more, slack) | (_spread(one << 1, slack - 1) if slack else 0)))


def fillings(stock: _Stock, total: int, budget: list[int]) -> Iterator[tuple[int, ...]]:
    """All multisets of remaining pieces with this total, larger pieces first; lazily, each step being paid from the budget."""
    if not total:
        yield ()
        return
    chosen: list[int] = []
    left = total
    tries = [total]  # at each depth the next length to try
    while tries:
        budget[0] -= 1
        fits = stock.bits & ((2 << min(tries[-1], left)) - 1) & ~1
        x = fits.bit_length() - 1
        if budget[0] < 0 or x <= 0:
            tries.pop()
            if chosen:
                back = chosen.pop()
                stock.put((back,))
                left += back
            if budget[0] < 0 and not tries:
                return
            continue
        tries[-1] = x - 1
        if x == left:
            stock.put(tuple(chosen))  # whoever asks for the next one finds the stock as it was
            yield (*chosen, x)
            stock.take(tuple(chosen))
            continue
        stock.take((x,))
        chosen.append(x)
        left -= x
        tries.append(x)


def completions(stock: _Stock, room: int, allowed: int, budget: list[int]) -> Iterator[tuple[int, ...]]:
    """Undominated fillings of the room that waste no more than is allowed, least waste first."""
    reach = stock.sums(room)
    for waste in range(min(room, allowed) + 1):
        if not reach >> (room - waste) & 1:
            continue
        for filling in fillings(stock, room - waste, budget):
            stock.take(filling)
            others = stock.bits
            stock.put(filling)
            if not dominated(filling, waste, others) and not (others & ((2 << waste) - 1) & ~1):
                yield filling
        if budget[0] < 0:
            return


def pack(counts: np.ndarray, nodes: int = NODES) -> list[tuple[int, ...]]:
    """The lengths in each bin. counts[i]: pieces of length i, up to the capacity."""
    cap = len(counts) - 1
    counts = np.asarray(counts, np.int64).copy()
    full = int(counts[cap])
    counts[cap] = 0
    best, bound = best_fit(counts), least_bins(counts)
    total = int((counts * np.arange(cap + 1)).sum())
    stock = _Stock(counts)
    chosen: list[tuple[int, ...]] = []
    waste, budget = 0, [nodes]
    frames: list[tuple[int, Iterator[tuple[int, ...]]]] = []
    back = False
    while len(best) > bound:
        if not back:
            if not stock.left:
                best = list(chosen)
                back = True
                continue
            top = stock.bits.bit_length() - 1
            stock.take((top,))
            frames.append((top, completions(stock, cap - top, (len(best) - 1) * cap - total - waste, budget)))
        if not frames or budget[0] < 0:
            break
        top, options = frames[-1]
        if back and len(chosen) == len(frames):
            last = chosen.pop()
            stock.put(last[1:])
            waste -= cap - sum(last)
        filling = next(options, None)
        if filling is None or waste + cap - top - sum(filling) > (len(best) - 1) * cap - total:
            options.close()
            stock.put((top,))  # later fillings waste no less
            frames.pop()
            back = True
            continue
        stock.take(filling)
        chosen.append((top, *filling))
        waste += cap - top - sum(filling)
        back = False
    return [(cap,)] * full + best


def _place(batches: Iterator[pa.RecordBatch], capacity: int) -> Iterator[pa.RecordBatch]:
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    table = pa.Table.from_batches(parts).sort_by([("shard", "ascending"), ("uid", "ascending"), ("piece", "ascending")])
    shard = table.column("shard").to_numpy()
    length = table.column("length").to_numpy()
    sequence, offset = np.zeros(len(shard), np.int64), np.zeros(len(shard), np.int64)
    for s in np.unique(shard):
        own = np.flatnonzero(shard == s)
        queue: dict[int, list[int]] = defaultdict(list)
        for i in own[::-1].tolist():
            queue[int(length[i])].append(i)
        for k, filling in enumerate(pack(np.bincount(length[own], minlength=capacity + 1))):
            at = 0
            for x in filling:
                i = queue[x].pop()
                sequence[i], offset[i] = (int(s) << 32) + k, at
                at += x
    table = table.drop_columns(["uid", "shard"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
    yield from table.combine_chunks().to_batches(max_chunksize=50_000)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer: tuple[str, str, str] | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cutted = Scratch(docs.sparkSession).write(pieces(docs, capacity, tokenizer))
    shards = max(1, -(-cutted.count() // PER_SHARD))
    dealt = cutted.withColumn("shard", F.pmod(F.xxhash64("uid", "piece"), F.lit(shards)).cast("int"))
    return dealt.repartition(shards, "shard").mapInArrow(lambda x: _place(x, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
