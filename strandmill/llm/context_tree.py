"""Language-model scoring by context-tree weighting over bytes.

A text is coded as one stream of bytes: its words in order, each with a closing space, and at last an end symbol. A byte is coded as
the binary decisions on its way down a Huffman tree (of all training bytes, so that common bytes take few decisions); a decision's
context is the `DEPTH` preceding bytes of the stream, across words, with newlines before the text's start. For each context and
decision, Krichevsky-Trofimov estimates are mixed across all depths from 0 to DEPTH with the weights that context-tree weighting
gives them: at a node, half the KT probability of all its training decisions against half the product of its children's weighted
probabilities. Below the deepest context seen in training, the mixture of those seen holds. The score is the sum over the stream of
the log10 probabilities; bits_per_byte is the code length of a byte of it.

Texts are worked on in batches of `BATCH_BYTES`. A batch asks for the scores of its distinct grams (DEPTH context bytes and a byte) and for
the counts of its distinct words, with its own training counts of them: one sorted, difference-coded blob for each shard. A shard has
all grams whose `TOP` nearest context bytes hash to it, hence whole subtrees of that depth; it adds up the batches' counts, builds and
weighs its subtrees in parts, and answers each batch in the order in which it asked, with 4-byte numbers. The levels above TOP are made from
the subtrees' sums; they have at most 256 ** (TOP - 1) x 255 nodes, however large the corpus is, and are the only thing that is collected. Nothing that grows with the corpus is.

Defined cases: a null or empty text is the end symbol alone. A null doc_id is in the training part. With no training text every
decision has probability 1/2. Repeated rows each count and are scored each. An empty table gives an empty result. A very long text is a
batch of its own. Nothing is ranked, so there are no ties but equal bytes in the Huffman tree, which go by their value. Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, partition_keys, text_or_empty

DEPTH, TOP = 6, 3
#: Context bytes in a key of 8 bytes; those beyond DEPTH are 0.
WIDTH = 7
START, END = b"\n" * WIDTH, b""
BATCH_BYTES, GRAM_SHARD_BYTES, WORD_SHARD_BYTES, PART, SLOT_BITS = 1 << 23, 40_000_000, 100_000_000, 200_000, 23
#: Bytes of streams whose grams are in memory at once.
SLICE_BYTES = 1 << 20
LOG10 = np.log(10.0)
REQUEST = "batch long, shard int, asked binary, tokens long"
ANSWER = "batch long, shard int, answer binary, distinct long"


def _squeeze(*parts: bytes) -> bytes:
    head = np.array([len(parts), *map(len, parts)], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(b"".join([head, *parts]))


def _expand(blob: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    at, out = 8 * (n + 1), []
    for size in np.frombuffer(raw, "<i8", n, 8).tolist():
        out.append(raw[at : at + size])
        at += size
    return out


def _numbers(x: np.ndarray) -> list[bytes]:
    """Whole numbers that aren't negative, in as few bytes as the largest takes."""
    kind = np.min_scalar_type(int(x.max()) if len(x) else 0)
    return [kind.str.encode(), x.astype(kind).tobytes()]


def _array(parts: list[bytes]) -> np.ndarray:
    return np.frombuffer(parts[1], np.dtype(parts[0].decode())).astype(np.int64)


def _planes(sorted_: np.ndarray) -> bytes:
    """Differences by bytes of equal weight, of which most are zero."""
    return np.ascontiguousarray(np.diff(sorted_, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T).tobytes()


def _unplane(raw: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").ravel(), dtype=np.uint64)


# --- streams and grams --------------------------------------------------------------------------------------------------
def stream(text: bytes) -> tuple[list[bytes], bytes]:
    """The tokens and the coded bytes of a text."""
    words = text.lower().split()  # of bytes: A-Z and ASCII white space only
    return [*words, END], b" ".join([*words, b"\n"])


def grams(streams: list[bytes]) -> np.ndarray:
    """For each byte of the streams: the bytes before it, nearest first from the top, and itself as the lowest."""
    if not streams:
        return np.zeros(0, np.uint64)
    buf = b"".join([x for s in streams for x in (START, s)])
    word = np.ndarray((len(buf) - WIDTH,), "<u8", buf, strides=(1,))
    size = np.fromiter(map(len, streams), np.int64, len(streams))
    begin = np.cumsum(size + WIDTH) - size - WIDTH
    # The windows that begin in the last bytes of a stream reach into the next one.
    word = np.concatenate([word[a : a + n] for a, n in zip(begin.tolist(), size.tolist(), strict=True)])
    symbol = word >> np.uint64(56)
    word <<= np.uint64(8)
    word &= _mask(DEPTH - 1)
    word |= symbol
    return word


def runs(sorted_: np.ndarray) -> np.ndarray:
    """Where equal values begin."""
    return np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1]))) if len(sorted_) else np.zeros(0, np.int64)


def slices(streams: list[bytes]) -> Iterator[list[bytes]]:
    held, size = [], 0
    for s in streams:
        held.append(s)
        size += len(s)
        if size >= SLICE_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """All values of the parts, sorted, with the sums of their counts. The list of parts is emptied, so that they are not in memory twice."""
    value, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    parts.clear()
    order = np.argsort(value)
    value, n = value[order], n[order]
    del order
    first = runs(value)
    return value[first], np.add.reduceat(n, first, dtype=np.int64) if len(first) else n.astype(np.int64)


def distinct_grams(streams: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The grams of the streams, sorted, with their counts."""
    parts = [(np.zeros(0, np.uint64), np.zeros(0, np.int32))]
    for own in slices(streams):
        gram = grams(own)
        gram.sort()
        first = runs(gram)
        n = np.diff(np.append(first, len(gram)))
        parts.append((gram[first], n.astype(np.int32) if len(gram) < 1 << 31 else n))
    return added(parts)


def gram_values(streams: list[bytes]) -> np.ndarray:
    """As distinct_grams(), without the counts."""
    parts = [np.zeros(0, np.uint64)]
    for own in slices(streams):
        gram = grams(own)
        gram.sort()
        parts.append(gram[runs(gram)])
    every = np.concatenate(parts)
    parts.clear()
    every.sort()
    return every[runs(every)]


def gram_shards(gram: np.ndarray, shards: int) -> np.ndarray:
    shard = gram >> np.uint64(64 - 8 * TOP)
    with np.errstate(over="ignore"):
        shard *= np.uint64(0x9E3779B97F4A7C15)
    shard >>= np.uint64(32)
    shard %= np.uint64(shards)
    return shard.astype(np.min_scalar_type(shards))


class Places:
    """Where values stand among sorted ones, all of which are there: by a hash table, and by bisection where two share a slot."""

    def __init__(self, sorted_: np.ndarray):
        self.sorted, self.table = sorted_, np.zeros(1 << SLOT_BITS, np.int32)
        self.table[self._slot(sorted_)] = np.arange(len(sorted_), dtype=np.int32)

    @staticmethod
    def _slot(x: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def of(self, wanted: np.ndarray) -> np.ndarray:
        at = self.table[self._slot(wanted)]
        other = np.flatnonzero(self.sorted[at] != wanted)
        at[other] = np.searchsorted(self.sorted, wanted[other])
        return at


class _Batch:
    """Texts with their streams, and what they ask for: grams in order, and words in order, by shard. Tokens are held as numbers."""

    def __init__(self, texts: Iterable[bytes]):
        number: defaultdict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        self.streams: list[bytes] = []
        ids, size = array("i"), array("q")
        for t in texts:
            tokens, own = stream(t)
            ids.extend(map(number.__getitem__, tokens))
            size.append(len(tokens))
            self.streams.append(own)
        number.default_factory = None  # it refers to the table, which would stay in memory
        self.number, self.ids, self.size = number, np.frombuffer(ids, np.int32), np.frombuffer(size, np.int64)

    def ask(self, train: np.ndarray, keys: np.ndarray, word_keys: np.ndarray) -> Iterator[tuple[int, bytes, int]]:
        """(shard key, blob, training tokens)."""
        known, rest = (distinct_grams([s for s, t in zip(self.streams, train, strict=True) if t == x]) for x in (True, False))
        parts = [known, (rest[0], np.zeros(len(rest[0]), np.int64))]
        del known, rest
        every, count = added(parts)
        shard = gram_shards(every, len(keys))
        order = np.argsort(shard, kind="stable")
        cuts = runs(shard[order])
        for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
            own = order[a:b]
            yield int(keys[shard[own[0]]]), _squeeze(_planes(every[own]), *_numbers(count[own])), 0
        del every, count, shard, order
        tokens = np.bincount(self.ids[np.repeat(train, self.size)], minlength=len(self.number))
        for s, own, ids in self._words(len(word_keys)):
            yield len_words(keys) + int(word_keys[s]), _squeeze(b"\n".join(own), *_numbers(tokens[ids])), int(tokens[ids].sum())

    def _words(self, shards: int) -> Iterator[tuple[int, list[bytes], np.ndarray]]:
        """Each shard's distinct words, in order, and their numbers."""
        ordered = sorted(self.number)
        ids = np.fromiter(map(self.number.__getitem__, ordered), np.int32, len(ordered))
        shard = np.fromiter(map(zlib.crc32, ordered), np.int64, len(ordered)) % shards
        order = np.argsort(shard, kind="stable")
        cuts = runs(shard[order])
        for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
            own = order[a:b]
            yield int(shard[own[0]]), [ordered[i] for i in own.tolist()], ids[own]

    def scores(self, answers: dict[int, bytes], shards: int, word_shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: score, known tokens, and the sum of log10(c + 1). answers: by shard, word shards after the others."""
        every = gram_values(self.streams)
        shard = gram_shards(every, shards)
        by_shard = np.argsort(shard, kind="stable")
        value = np.empty(len(every), "<f4")
        cuts = runs(shard[by_shard])
        for a, b in zip(cuts, [*cuts[1:], len(by_shard)], strict=True):
            value[by_shard[a:b]] = np.frombuffer(_expand(answers[int(shard[by_shard[a]])])[0], "<f4")
        del shard, by_shard
        stand, score = Places(every), [np.zeros(0)]
        for own in slices(self.streams):
            size = np.fromiter(map(len, own), np.int64, len(own))
            score.append(np.add.reduceat(value[stand.of(grams(own))].astype(float), np.cumsum(size) - size))
        del every, value, stand
        count = np.zeros(len(self.number), np.int64)
        for s, _, ids in self._words(word_shards):
            count[ids] = _array(_expand(answers[shards + s]))
        begin = np.cumsum(self.size) - self.size
        return np.concatenate(score), np.add.reduceat((count > 0).astype(np.int64)[self.ids], begin), np.add.reduceat(np.log10(count + 1.0)[self.ids], begin)


def len_words(keys: np.ndarray) -> int:
    """Word shards have keys above those of the gram shards."""
    return int(keys.max()) + 1


# --- the tree -----------------------------------------------------------------------------------------------------------
class Code:
    """A Huffman tree of the 256 bytes: for each byte its decisions (node, bit) from the root."""

    def __init__(self, counts: np.ndarray):
        heap = [(int(n) + 1, k, k) for k, n in enumerate(counts)]  # weight, order, node: bytes, then inner nodes from 256 on
        heapq.heapify(heap)
        up: dict[int, tuple[int, int]] = {}
        for node in range(256, 511):
            (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
            up[x], up[y] = (node, 0), (node, 1)
            heapq.heappush(heap, (a + b, node, node))
        self.path: list[list[tuple[int, int]]] = []
        for k in range(256):
            own, at = [], k
            while at in up:
                at, bit = up[at]
                own.append((510 - at, bit))  # the root is 0
            self.path.append(own[::-1])
        self.length = np.array([len(p) for p in self.path], np.int64)
        self.first = np.cumsum(self.length) - self.length
        self.node = np.array([n for p in self.path for n, _ in p], np.uint64)
        self.bit = np.array([b for p in self.path for _, b in p], np.int64)

    def decisions(self, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each gram's nodes (decision as the highest byte, then the context, nearest first), their bits, and where each gram's begin."""
        symbol = (gram & np.uint64(255)).astype(np.int64)
        n = self.length[symbol]
        begin = np.cumsum(n) - n
        flat = np.arange(int(n.sum())) + np.repeat(self.first[symbol] - begin, n)
        return (self.node[flat] << np.uint64(56)) | np.repeat(gram >> np.uint64(8), n), self.bit[flat], begin


_HALF = 0.5723649429247001  # log gamma of 1/2


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, for x of 16 and more."""
    inv = 1 / x
    return (x - 0.5) * np.log(x) - x + 0.9189385332046727 + inv / 12 - inv**3 / 360 + inv**5 / 1260


def _table(first: float, n: int) -> np.ndarray:
    """log gamma at first, first + 1, ..."""
    return np.concatenate(([_HALF if first == 0.5 else 0.0], np.cumsum(np.log(first + np.arange(n - 1))) + (_HALF if first == 0.5 else 0.0)))


_SMALL = 4096
_AT_HALF, _AT_ONE = _table(0.5, _SMALL), _table(1.0, _SMALL)


def _gamma_of(n: np.ndarray, plus: float, table: np.ndarray) -> np.ndarray:
    out = table[np.minimum(n, _SMALL - 1)]
    large = np.flatnonzero(n >= _SMALL)
    out[large] = _log_gamma(n[large] + plus)
    return out


def kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return _gamma_of(n0, 0.5, _AT_HALF) + _gamma_of(n1, 0.5, _AT_HALF) - _gamma_of(n0 + n1, 1.0, _AT_ONE) - 2 * _HALF


def _mask(depth: int) -> np.uint64:
    """Keeps a node's decision and its `depth` nearest context bytes."""
    return np.uint64(((1 << 8 * (depth + 1)) - 1) << 8 * (WIDTH - depth))


class Level:
    """Nodes of one depth, sorted: counts, log KT, log product of the children's weighted probabilities."""

    __slots__ = ("keys", "n0", "n1", "own", "product", "up")

    def __init__(self, keys: np.ndarray, n0: np.ndarray, n1: np.ndarray, product: np.ndarray | None = None):
        self.keys, self.n0, self.n1, self.own = keys, n0, n1, kt(n0, n1)
        self.product = self.own if product is None else product
        self.up = np.zeros(0, np.int64)  # places in the level above

    def weighted(self) -> np.ndarray:
        return self.own if self.product is self.own else np.logaddexp(self.own, self.product) - np.log(2.0)

    def above(self, depth: int) -> Level:
        """The level of this depth, one less than the own; sets up."""
        keys = self.keys & _mask(depth)
        first = runs(keys)
        self.up = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(keys))))
        if not len(keys):
            return Level(keys, self.n0, self.n1, np.zeros(0))
        return Level(keys[first], np.add.reduceat(self.n0, first), np.add.reduceat(self.n1, first), np.add.reduceat(self.weighted(), first))


class Subtrees:
    """Levels TOP..DEPTH of the grams (n: their training counts, 0 allowed), and for each decision of a gram its place on the last level."""

    def __init__(self, gram: np.ndarray, n: np.ndarray, code: Code):
        node, self.bit, self.begin = code.decisions(gram)
        weight = np.repeat(n, code.length[(gram & np.uint64(255)).astype(np.int64)])
        order = np.argsort(node)
        node, weight, bit = node[order], weight[order], self.bit[order]
        first = runs(node)
        self.place = np.empty(len(node), np.int64)
        self.place[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(node))))
        total = np.add.reduceat(weight, first) if len(first) else weight
        ones = np.add.reduceat(weight * bit, first) if len(first) else weight
        self.levels = [Level(node[first], total - ones, ones)]
        for depth in range(DEPTH - 1, TOP - 1, -1):
            self.levels.insert(0, self.levels[0].above(depth))

    def sums(self) -> Level:
        """Of these subtrees alone: the level above TOP."""
        return self.levels[0].above(TOP - 1)

    def scores(self, top: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """log10 probability of each gram's byte. top: nodes of the level above TOP, and what mix() gives for them."""
        self.levels[0].up = np.searchsorted(top[0], self.levels[0].keys & _mask(TOP - 1))
        p = mix(self.levels, top[1:])[0][self.place]
        return np.add.reduceat(np.log(np.where(self.bit == 1, p, 1 - p)), self.begin) / LOG10 if len(p) else p


def mix(levels: list[Level], above: tuple[np.ndarray, np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the nodes of the last level: the probability of bit 1 with contexts up to there, what is mixed so far, and the weight left.
    above: the same for the level before the first."""
    for level in levels:
        n = level.n0 + level.n1
        estimate = (level.n1 + 0.5) / (n + 1)
        weight = 1 / (1 + np.exp(np.clip(level.product - level.own, -700, 700)))
        if above is None:
            upper, so_far, left = np.full(len(n), 0.5), np.zeros(len(n)), np.ones(len(n))
        else:
            upper, so_far, left = (x[level.up] for x in above)
        seen = n > 0  # below the deepest context seen, its mixture holds
        above = np.where(seen, so_far + left * estimate, upper), np.where(seen, so_far + left * weight * estimate, upper), np.where(seen, left * (1 - weight), 0.0)
    return above


def top_nodes(keys: np.ndarray, n0: np.ndarray, n1: np.ndarray, product: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The level above TOP from its sums, mixed with all levels above it."""
    order = np.argsort(keys)
    levels = [Level(keys[order], n0[order], n1[order], product[order])]
    for depth in range(TOP - 2, -1, -1):
        levels.insert(0, levels[0].above(depth))
    return (levels[-1].keys, *mix(levels, None))


# --- the jobs -----------------------------------------------------------------------------------------------------------
def _requests(batches: Iterator[pa.RecordBatch], keys: np.ndarray, word_keys: np.ndarray) -> Iterator[pa.RecordBatch]:
    part, turn = TaskContext.get().partitionId(), 0
    held: list[tuple[int | None, bool, bytes]] = []
    size = 0

    def flush() -> pa.RecordBatch:
        train = [not h for _, h, _ in held]
        batch = _Batch(t for _, _, t in held)
        histogram = np.zeros(256, np.int64)
        for own in slices([s for s, t in zip(batch.streams, train, strict=True) if t]):
            histogram += np.bincount(np.frombuffer(b"".join(own), np.uint8), minlength=256)
        ids = np.array([-1 if d is None else d for d, _, _ in held], "<i8")
        missing = np.array([d is None for d, _, _ in held])
        whole = _squeeze(ids.tobytes(), missing.tobytes(), np.array(train).tobytes(), *_numbers(np.array([len(t) for _, _, t in held], np.int64)), b"".join([t for _, _, t in held]))
        rows = [(-1, whole, 0), (-2, histogram.astype("<i8").tobytes(), 0), *batch.ask(np.array(train), keys, word_keys)]
        key = (part << 24) + turn
        return pa.RecordBatch.from_arrays([pa.array([key] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int64())], ["batch", "shard", "asked", "tokens"])

    for b in batches:
        for d, h, t in zip(b.column("doc_id").to_pylist(), b.column("held_out").to_pylist(), b.column("text"), strict=True):
            held.append((d, h, t.as_py().encode("utf-8", "surrogatepass")))
            size += len(held[-1][2])
            if size >= BATCH_BYTES:
                yield flush()
                held.clear()
                size, turn = 0, turn + 1
    if held:
        yield flush()


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(256, np.int64)
    for b in batches:
        for blob in b.column("asked"):
            total += np.frombuffer(blob.as_py(), "<i8")
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(256), pa.int32()), pa.array(total)], ["byte", "n"])


def _by_shard(batches: Iterator[pa.RecordBatch]) -> dict[int, list[tuple[int, bytes]]]:
    """(batch, blob) of each shard, in order of batches. Blobs stay compressed."""
    held: dict[int, list[tuple[int, bytes]]] = {}
    for b in batches:
        for shard, batch, blob in zip(b.column("shard").to_pylist(), b.column("batch").to_pylist(), b.column("asked"), strict=True):
            held.setdefault(shard, []).append((batch, blob.as_py()))
    for own in held.values():
        own.sort()
    return held


def _merged(blobs: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """All grams of a shard, sorted, with the sums of their counts."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for _, blob in blobs:
        planes, *count = _expand(blob)
        held.append((_unplane(planes), _array(count)))
        if len(held) > 1 and sum(len(g) for g, _ in held) > max(1_000_000, 2 * len(held[0][0])):
            held = [added(held)]
    return added(held)


def _parts(gram: np.ndarray) -> Iterator[slice]:
    """Whole subtrees, of at least PART grams together."""
    near = gram >> np.uint64(64 - 8 * TOP)
    first = runs(near)
    at = 0
    while at < len(gram):
        later = first[np.searchsorted(first, at + PART) :]
        end = int(later[0]) if len(later) else len(gram)
        yield slice(at, end)
        at = end


def _top_sums(batches: Iterator[pa.RecordBatch], code: Code) -> Iterator[pa.RecordBatch]:
    for blobs in _by_shard(batches).values():
        gram, n = _merged(blobs)
        for part in _parts(gram):
            level = Subtrees(gram[part], n[part], code).sums()
            yield pa.RecordBatch.from_arrays([pa.array(level.keys.view(np.int64)), pa.array(level.n0), pa.array(level.n1), pa.array(level.product)], ["node", "n0", "n1", "product"])


def _answer_grams(batches: Iterator[pa.RecordBatch], code: Code, top: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
    for shard, blobs in _by_shard(batches).items():
        gram, n = _merged(blobs)
        score = np.concatenate([Subtrees(gram[part], n[part], code).scores(top) for part in _parts(gram)]).astype("<f4")
        for batch, blob in blobs:
            own = score[np.searchsorted(gram, _unplane(_expand(blob)[0]))]
            yield _answer(batch, shard, _squeeze(own.tobytes()), 0)


def _answer_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for shard, blobs in _by_shard(batches).items():
        total: dict[bytes, int] = {}
        for _, blob in blobs:
            words, *count = _expand(blob)
            for w, c in zip(words.split(b"\n"), _array(count).tolist(), strict=True):
                total[w] = total.get(w, 0) + c
        for batch, blob in blobs:
            own = np.array([total[w] for w in _expand(blob)[0].split(b"\n")], np.int64)
            yield _answer(batch, shard, _squeeze(*_numbers(own)), 0)
        yield _answer(-1 - shard, shard, b"", sum(c > 0 for c in total.values()))


def _answer(batch: int, shard: int, blob: bytes, distinct: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([batch], pa.int64()), pa.array([shard], pa.int32()), pa.array([blob], pa.binary()), pa.array([distinct], pa.int64())], ["batch", "shard", "answer", "distinct"])


def _finish(asked: pa.Table, answers: pa.Table, keys: np.ndarray, word_keys: np.ndarray) -> pa.Table:
    number = {int(k): s for s, k in enumerate(keys)} | {len_words(keys) + int(k): len(keys) + s for s, k in enumerate(word_keys)}
    got = {number[s]: blob.as_py() for s, blob in zip(answers.column("shard").to_pylist(), answers.column("answer"), strict=True)}
    ids, missing, train, *size, text = _expand(asked.column("asked")[0].as_py())
    ends = np.cumsum(_array(size))
    batch = _Batch(text[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True))
    del text
    score, known, base = batch.scores(got, len(keys), len(word_keys))
    doc_id = pa.array(np.frombuffer(ids, "<i8"), pa.int64(), mask=np.frombuffer(missing, bool))
    coded = np.array([len(s) for s in batch.streams], np.int64)
    return pa.table({"doc_id": doc_id, "held_out": pa.array(~np.frombuffer(train, bool)), "n_tokens": pa.array(batch.size), "n_known": pa.array(known), "base": pa.array(base), "score": pa.array(score), "n_coded": pa.array(coded)})


def remainder(mod: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    scratch = Scratch(docs.sparkSession)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    keys, word_keys = partition_keys(max(6, total // GRAM_SHARD_BYTES)), partition_keys(max(6, total // WORD_SHARD_BYTES))
    rows = docs.select("doc_id", F.coalesce(remainder(7) == 2, F.lit(False)).alias("held_out"), text_or_empty().alias("text"))
    requests = scratch.write(rows.mapInArrow(lambda x: _requests(x, keys, word_keys), REQUEST))
    histogram = requests.where("shard = -2").select("asked").mapInArrow(_histogram, "byte int, n long").groupBy("byte").agg(F.sum("n").alias("n"))
    counts = np.zeros(256, np.int64)
    for r in histogram.collect():  # 256 rows
        counts[r.byte] = r.n
    code = Code(counts)
    for_words = F.col("shard") >= len_words(keys)
    asked_grams = requests.where((F.col("shard") >= 0) & ~for_words).select("batch", "shard", "asked").repartition(len(keys), "shard")
    asked_words = requests.where(for_words).select("batch", "shard", "asked").repartition(len(word_keys), F.col("shard") - len_words(keys))
    sums = asked_grams.mapInArrow(lambda x: _top_sums(x, code), "node long, n0 long, n1 long, product double").groupBy("node").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "product")])
    got = scratch.write(sums).toArrow()  # at most 256 ** (TOP - 1) contexts x 255 decisions
    column = lambda c: got.column(c).to_numpy()
    top = top_nodes(column("node").view(np.uint64), column("n0"), column("n1"), column("product"))
    of_words = scratch.write(asked_words.mapInArrow(_answer_words, ANSWER))
    tokens, distinct = requests.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0], of_words.agg(F.coalesce(F.sum("distinct"), F.lit(0))).first()[0]
    answers = asked_grams.mapInArrow(lambda x: _answer_grams(x, code, top), ANSWER).unionByName(of_words)
    texts = requests.where("shard = -1").select("batch", "asked")
    done = texts.groupBy("batch").cogroup(answers.where("batch >= 0").select("batch", "shard", "answer").groupBy("batch")).applyInArrow(
        lambda a, b: _finish(a, b, keys, word_keys), "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, n_coded long"
    )
    return done.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * float(np.log10(tokens + distinct + 1))).alias("base_score"), "score",
        (-F.col("score") * float(np.log2(10)) / F.col("n_coded")).alias("bits_per_byte"),
    )
