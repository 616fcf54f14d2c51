"""Near-duplicates by SimHash, linked through meet-in-the-middle ball hashing.

Two fingerprints at most `2 * half` bits apart have a value at most `half` bits from either. So every distinct fingerprint
emits all values within `half` bits of it (2081 for half = 2 and 64 bits), and fingerprints that meet at a value are
linked. As any two that meet there are within 2 * half bits of each other, linking each to the least of them loses no
connection, and a crowd of m at one value costs m - 1 links, not m squared. Links are verified by bit count.

Values are shuffled in blobs, not as rows: for each batch of fingerprints and each bucket one sorted, difference-coded,
compressed array of values with the number of the flipped mask (2 bytes), from which the fingerprint is recovered.
The pipeline asks for similarity 0.8, which is near 10 bits, beyond any ball that can be emitted. There texts are linked
besides when their sets of shingles share a MinHash band and an exact check of the two sets finds the similarity; of the pairs in a bucket
a spanning forest is checked, not all (similar_links).

A value's syndrome (three parities) says in which of eight rounds it is handled, so that a round's shuffle is an eighth
of the whole; each round's links are written to shared storage.

Defined cases: a text without words (null, empty, blank) has fingerprint zero and is linked like any other; fewer words
than a shingle make one shingle. Rows with the same fingerprint are one node. A null doc_id takes no part in the least
id; a component of such rows only has a null id. Repeated rows each get a row. An empty table gives an empty result. A bit that
is set in exactly half of the hashes is 0. A very long text is hashed whole, its bits being summed in parts. Other columns are ignored,
whatever their names, and kept by `near_dedup`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Scratch, join_hot, partition_keys, unused
from .components import components

BITS, SEED = 64, 42
ROUND_BITS = 3
#: An odd multiplier spreads values over buckets, and its inverse recovers them.
MULTIPLIER = 0x9E3779B97F4A7C15
INVERSE = pow(MULTIPLIER, -1, 1 << 64)
VALUES_PER_BUCKET, BATCH = 3_000_000, 8192
#: Sets in a bucket's part, and hashes in them together.
PART_SETS, PART_HASHES = 4096, 4_000_000
#: At similarity 0.8 two sets share none of 25 bands of 4 MinHash values with a chance of 2 in a million.
BANDS, ROWS = 25, 4
FLIPS, FACTORS = np.random.default_rng(SEED).integers(0, 1 << 32, (2, BANDS * ROWS), np.uint32)
FACTORS |= np.uint32(1)


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """The hash of each shingle, in order, repeats included."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    n = len(parts)
    if not n:
        return np.zeros(0, "<u8")
    joined = b" ".join(parts)
    if n <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], "<u8")
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s:e], SEED) for s, e in zip(starts[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)], "<u8")


def majority(hashes: np.ndarray) -> int:
    total = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        total += np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int) -> int:
    """A bit is 1 if it is set in over half of the hashes of the shingles."""
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, row_key (of doc_id and text), fp (signed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in b.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row_key"), pa.array(fps, pa.int64())], ["doc_id", "row_key", "fp"])

    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), "text").mapInArrow(run, "doc_id long, row_key long, fp long")


def masks(half: int) -> np.ndarray:
    return np.array([sum(1 << i for i in c) for k in range(half + 1) for c in combinations(range(BITS), k)], np.uint64)


def syndromes(values: np.ndarray) -> np.ndarray:
    """ROUND_BITS parities of each value; that of a xor b is that of a xor that of b."""
    out = np.zeros(len(values), np.uint8)
    for k in range(ROUND_BITS):
        taken = np.uint64(sum(1 << i for i in range(BITS) if i % 7 + 1 & 1 << k))
        out |= (np.bitwise_count(values & taken).astype(np.uint8) & 1) << k
    return out


def _pack(values: np.ndarray, number: np.ndarray) -> bytes:
    delta = np.diff(values, prepend=np.uint64(0))
    planes = delta.view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(len(values).to_bytes(4, "little") + np.ascontiguousarray(planes).tobytes() + number.astype("<u2").tobytes())


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(raw[:4], "little")
    planes = np.frombuffer(raw, np.uint8, 8 * n, 4).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64), np.frombuffer(raw, "<u2", n, 4 + 8 * n)


def _emit(batches: Iterator[pa.RecordBatch], turn: int, keys: np.ndarray, half: int) -> Iterator[pa.RecordBatch]:
    flips, buckets = masks(half), len(keys)
    own = syndromes(flips)
    for b in batches:
        fps = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        for k in range(0, len(fps), BATCH):
            part = fps[k : k + BATCH]
            syn = syndromes(part)
            values, numbers = [], []
            for s in range(1 << ROUND_BITS):
                chosen = np.flatnonzero(own == (s ^ turn)).astype(np.uint16)
                with np.errstate(over="ignore"):
                    values.append(((part[syn == s][:, None] ^ flips[chosen][None, :]) * np.uint64(MULTIPLIER)).ravel())
                numbers.append(np.tile(chosen, int((syn == s).sum())))
            v, i = np.concatenate(values), np.concatenate(numbers)
            order = np.argsort(v)
            v, i = v[order], i[order]
            cuts = np.searchsorted(v, np.array([(j << 64) // buckets for j in range(1, buckets)], np.uint64)) if buckets > 1 else np.array([], np.int64)
            edges = [0, *cuts.tolist(), len(v)]
            full = [j for j in range(buckets) if edges[j] < edges[j + 1]]
            yield pa.RecordBatch.from_arrays([pa.array(keys[full], pa.int32()), pa.array([_pack(v[edges[j] : edges[j + 1]], i[edges[j] : edges[j + 1]]) for j in full], pa.binary())], ["bucket", "blob"])


def _meet(batches: Iterator[pa.RecordBatch], half: int) -> Iterator[pa.RecordBatch]:
    flips, held = masks(half), {}
    for b in batches:
        for bucket, blob in zip(b.column("bucket").to_pylist(), b.column("blob").to_pylist(), strict=True):
            held.setdefault(bucket, []).append(blob)
    for bucket in list(held):
        parts = [_unpack(x) for x in held.pop(bucket)]
        v, i = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(v)
        v, i = v[order], i[order]
        first = np.concatenate(([True], v[1:] != v[:-1]))
        shared = ~(first & np.concatenate((first[1:], [True])))
        v, i, first = v[shared], i[shared], first[shared]
        if not len(v):
            continue
        with np.errstate(over="ignore"):
            fps = (v * np.uint64(INVERSE)) ^ flips[i]
        starts = np.flatnonzero(first)
        least = np.repeat(np.minimum.reduceat(fps, starts), np.diff(np.append(starts, len(v))))
        pair = np.unique(np.stack([fps, least], 1)[(fps != least) & (np.bitwise_count(fps ^ least) <= 2 * half)], axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pair[:, k].copy().view(np.int64), pa.int64()) for k in (0, 1)], ["a", "b"])


def links(fps: DataFrame, scratch: Scratch, half: int = 2) -> DataFrame:
    """a, b: links between distinct fingerprints fp that connect all within 2 * half bits."""
    n = fps.count()
    per_round = max(1, n * len(masks(half)) >> ROUND_BITS)
    buckets = max(1, -(-per_round // VALUES_PER_BUCKET))
    keys = partition_keys(buckets)
    spread = scratch.write(fps.repartition(max(6, -(-n // (2 * BATCH)))))
    out = []
    for turn in range(1 << ROUND_BITS):
        blobs = spread.mapInArrow(lambda x, t=turn: _emit(x, t, keys, half), "bucket int, blob binary")
        met = blobs.repartition(buckets, "bucket").mapInArrow(lambda x: _meet(x, half), "a long, b long")
        out.append(scratch.write(met.distinct()))
    return out[0] if len(out) == 1 else _union(out).distinct()


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for x in frames[1:]:
        out = out.unionByName(x)
    return out


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each band of ROWS MinHash values of the set of hashes."""
    x = (hashes >> np.uint64(32)).astype(np.uint32) ^ hashes.astype(np.uint32)
    low = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 2048):
        low = np.minimum(low, ((x[None, k : k + 2048] ^ FLIPS[:, None]) * FACTORS[:, None]).min(1))
    low = low.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(MULTIPLIER)
    for r in range(ROWS):
        key = (key ^ low[:, r]) * np.uint64(0xC2B2AE3D27D4EB4F)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """As fingerprints(), with set_key (a hash of the set of shingles), its size, and its bands; no bands without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, sets, sizes, bands = [], [], [], []
            for t in b.column("text"):
                hashes = shingle_hashes(t.as_py(), shingle)
                fps.append(majority(hashes))
                own = np.unique(hashes)
                sets.append(xxhash.xxh64_intdigest(own.tobytes(), SEED))
                sizes.append(len(own))
                bands.append(band_keys(own) if len(own) else np.zeros(0, np.int64))
            signed = [pa.array(np.array(x, np.uint64).view(np.int64), pa.int64()) for x in (fps, sets)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row_key"), *signed, pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "row_key", "fp", "set_key", "size", "bands"])

    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), "text").mapInArrow(run, "doc_id long, row_key long, fp long, set_key long, size long, bands array<long>")


def _few(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it is counted to have few rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def level(size: int) -> int:
    """Sets are compared with those of like size: level k has sizes above 2 ** (k - 1), up to 2 ** k."""
    return (size - 1).bit_length()


def top_size(size: int, least: float) -> int:
    """The largest set that can have the similarity to one of this size."""
    return int(size / least + 1e-9)


def sketch(hashes: np.ndarray, k: int) -> bytes:
    """For level k: of at least 64 bits, and 4 for each of 2 ** k hashes, the parity of the hashes that fall on it. Two sketches don't differ in
    more bits than there are hashes in just one of the sets."""
    bits = max(6, k + 2)
    with np.errstate(over="ignore"):
        place = (hashes * np.uint64(MULTIPLIER)) >> np.uint64(64 - bits)
    return np.packbits((np.bincount(place.astype(np.int64), minlength=1 << bits) & 1).astype(bool), bitorder="little").tobytes()


def _shingle_sets(docs: DataFrame, owners: DataFrame, shingle: int, least: float) -> DataFrame:
    """set_key, hashes of the sets in owners (set_key, row_key), and their sketches for all levels of sets that can be similar, from their own on."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), shingle)) for t in b.column("text")]
            sketches = [[sketch(x, k) for k in range(level(len(x)), level(top_size(len(x), least)) + 1)] for x in sets]
            yield pa.RecordBatch.from_arrays([b.column("set_key"), pa.array([x.tobytes() for x in sets], pa.binary()), pa.array(sketches, pa.list_(pa.binary()))], ["set_key", "hashes", "sketches"])

    texts = docs.select(F.xxhash64("doc_id", "text").alias("row_key"), "text").join(_few(owners.select("set_key", "row_key")), "row_key").select("set_key", "text")
    return texts.mapInArrow(read, "set_key long, hashes binary, sketches array<binary>").dropDuplicates(["set_key"])


def alike(x: bytes, y: bytes, least: float) -> bool:
    """If two sets have a Jaccard similarity of at least `least`."""
    x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= least * (len(x) + len(y) - both)


def _verified(sets: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """Those of the pairs (a, b, others) of set keys whose sets have a Jaccard similarity of at least `least`."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("x"), b.column("y"), strict=True):
                keep.append(alike(x.as_py(), y.as_py(), least))
            yield b.drop_columns(["x", "y"]).filter(pa.array(keep, pa.bool_()))

    wanted = _few(pairs.select(F.col("a").alias("set_key")).union(pairs.select("b")).distinct())
    asked = sets.join(wanted, "set_key", "left_semi")
    first = asked.select(F.col("set_key").alias("a"), F.col("hashes").alias("x"))
    second = asked.select(F.col("set_key").alias("b"), F.col("hashes").alias("y"))
    return pairs.join(first, "a").join(second, "b").select(*pairs.columns, "x", "y").mapInArrow(check, pairs.schema)


def distances(size: np.ndarray, bits: np.ndarray, own_size: int, own_bits: np.ndarray) -> np.ndarray:
    """How many hashes at least are in just one of two sets, as a share of both sizes together."""
    apart = np.bitwise_count(bits ^ own_bits).sum(1, dtype=np.int64)
    return np.maximum(apart, np.abs(size - own_size)) / (size + own_size)


def most_apart(least: float) -> float:
    """Beyond this distance no two sets have the similarity."""
    return (1 - least) / (1 + least) + 1e-9


def forest(size: np.ndarray, bits: np.ndarray, least: float) -> list[tuple[int, int]]:
    """A spanning forest, least distances first (Prim), of all pairs that can be similar enough."""
    k = len(size) - 1
    size, bits, ids = size.copy(), bits.copy(), np.arange(k + 1)
    near, by, most, out = np.full(k + 1, np.inf), np.zeros(k + 1, np.int64), most_apart(least), []
    while k:
        # Place k has the set that came last; those before it are still out of the forest.
        d = distances(size[:k], bits[:k], size[k], bits[k])
        closer = np.flatnonzero((d <= most) & (d < near[:k]))
        near[closer], by[closer] = d[closer], ids[k]
        j = int(near[:k].argmin())
        if near[j] < np.inf:
            out.append((int(by[j]), int(ids[j])))
        k -= 1
        for x in (size, bits, ids, near, by):
            x[[j, k]] = x[[k, j]]
    return out


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each value of the keys, from rows in their order."""
    held = None
    for b in batches:
        held = pa.Table.from_batches([b] if held is None else [*held.to_batches(), b])
        if not len(held):
            continue
        change = np.zeros(len(held) - 1, bool)
        for x in keys:
            v = held.column(x).to_numpy()
            change |= v[1:] != v[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist()]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            yield held.slice(lo, hi - lo)
        held = held.slice(cuts[-1])
    if held is not None and len(held):
        yield held


def _bits(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(len(column), -1)


def _forests(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    names = ["band", "level", "a", "b"]
    out: list[tuple[int, int, int, int]] = []
    for t in _groups(batches, ["band", "level", "part"]):
        keys, band, k = t.column("set_key").to_numpy(), t.column("band")[0].as_py(), t.column("level")[0].as_py()
        out.extend((band, k, *sorted((int(keys[i]), int(keys[j])))) for i, j in forest(t.column("size").to_numpy(), _bits(t.column("sketch")), least))
        if len(out) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if n == "level" else pa.int64()) for n, x in zip(names, zip(*out, strict=True), strict=True)], names)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if n == "level" else pa.int64()) for n, x in zip(names, zip(*out, strict=True), strict=True)], names)


def _compare(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Links between the probes of a group and its other rows that connect all that are similar enough; the sets themselves are compared."""
    for t in _groups(batches, ["band", "level", "part", "turn"]):
        probe = t.column("probe").to_numpy()
        base = np.flatnonzero(~probe)
        key, size, root, bits, hashes = t.column("set_key").to_numpy(), t.column("size").to_numpy(), t.column("root").to_pylist(), _bits(t.column("sketch")), t.column("hashes")
        up: dict[int, int] = {}

        def top(x: int, up: dict[int, int] = up) -> int:
            while x in up:
                up[x] = up.get(up[x], up[x])
                x = up[x]
            return x

        base_size, base_bits, found = size[base], bits[base], []
        for i in np.flatnonzero(probe).tolist():
            d = distances(base_size, base_bits, size[i], bits[i])
            near = np.flatnonzero(d <= most_apart(least))
            for j in base[near[np.argsort(d[near], kind="stable")]].tolist():
                x, y = top(root[i]), top(root[j])
                if x != y and alike(hashes[i].as_py(), hashes[j].as_py(), least):
                    up[max(x, y)] = min(x, y)
                    found.append(sorted((int(key[i]), int(key[j]))))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["a", "b"])


def similar_links(docs: DataFrame, rows: DataFrame, scratch: Scratch, shingle: int, least: float) -> DataFrame:
    """a, b: links between fingerprints that connect all sets of shingles that share a band and are similar enough.

    A bucket has the sets of one band, and of sizes that can be similar (level). Sketches give a distance that no two sets are nearer than, so pairs beyond
    `most_apart` need no check; of the others in a bucket, those of a spanning forest are checked, exactly. If all of them
    hold, or other links connect their ends, all that can be similar in the bucket is connected. Buckets where that isn't so are few; there, every set
    outside of the bucket's largest component is held against all sets of the bucket that are not connected to it, by sketch and then exactly.

    A bucket of over `PART_SETS` sets (or `PART_HASHES` hashes) is dealt into parts, with a forest in each, and always gets the second step while it has
    several components; there each part meets each part of the sets outside of the largest component."""
    sized = rows.where("size > 0")
    owners = scratch.write(sized.groupBy("set_key").agg(F.min("row_key").alias("row_key"), F.min("fp").alias("fp"), F.first("size").alias("size"), F.first("bands").alias("bands")))
    same = sized.join(owners.select("set_key", F.col("fp").alias("b")), "set_key").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()
    of_size = lambda n: F.when(n > 1, F.length(F.bin((n - 1).cast("long")))).otherwise(0)  # noqa: E731  level()
    own = of_size(F.col("size"))
    levels = F.sequence(own, of_size(F.floor(F.col("size") / F.lit(least) + F.lit(1e-9))))
    placed = owners.select("set_key", "size", F.explode("bands").alias("band"), own.alias("own"), levels.alias("levels")).select("set_key", "size", "band", "own", F.explode("levels").alias("level"))
    # Sets of lower levels alone meet in their own.
    parts = lambda n, hashes: F.greatest(F.ceil(n / F.lit(PART_SETS)), F.ceil(hashes / F.lit(PART_HASHES)), F.lit(1)).cast("int")
    shared = placed.groupBy("band", "level").agg(F.count("*").alias("n"), F.sum("size").alias("hashes"), F.max("own").alias("highest")).where("n > 1 and highest = level")
    met = placed.join(shared.select("band", "level", parts(F.col("n"), F.col("hashes")).alias("parts")), ["band", "level"])
    met = scratch.write(met.withColumn("part", F.pmod(F.xxhash64("set_key", "band"), F.col("parts")).cast("int")))
    sets = scratch.write(_shingle_sets(docs, owners.join(met.select("set_key").distinct(), "set_key", "left_semi"), shingle, least))
    its_sketch = F.element_at("sketches", F.col("level") - F.col("own") + 1).alias("sketch")

    keys = ["band", "level", "part"]
    sketched = met.join(sets.select("set_key", "sketches"), "set_key").select(*keys, "set_key", "size", its_sketch)
    forests = sketched.repartition(*keys).sortWithinPartitions(*keys, "set_key").mapInArrow(lambda x: _forests(x, least), "band long, level int, a long, b long")
    forests = scratch.write(forests)
    linked = scratch.write(_verified(sets, forests.select("a", "b").distinct(), least))
    roots = scratch.write(components(linked, scratch))
    root_of = lambda df, key, name: df.join(roots.select(F.col("node").alias(key), F.col("root").alias(name)), key, "left").withColumn(name, F.coalesce(name, key))
    refuted = root_of(root_of(forests.join(linked, ["a", "b"], "left_anti"), "a", "x"), "b", "y").where("x <> y").select("band", "level")
    unsure = refuted.union(met.where("parts > 1").select("band", "level")).distinct()
    rest = root_of(met.join(unsure, ["band", "level"], "left_semi"), "set_key", "root")
    kin = scratch.write(rest.groupBy("band", "level", "root").agg(F.count("*").alias("n"), F.sum("size").alias("hashes")))
    largest = kin.groupBy("band", "level").agg(F.max(F.struct("n", "root")).alias("s"), F.sum("n").alias("n"), F.sum("hashes").alias("hashes"), F.count("*").alias("components"))
    largest = scratch.write(largest.where("components > 1").select("band", "level", F.col("s.root").alias("main"), parts(F.col("n") - F.col("s.n"), F.col("hashes")).alias("turns")))
    found = linked.select("a", "b")
    if largest.limit(1).count():
        rest = rest.join(largest, ["band", "level"]).select(*keys, "set_key", "size", "own", "root", "parts", "turns", (F.col("root") != F.col("main")).alias("outside"))
        as_base = rest.withColumn("probe", F.lit(False)).withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))
        as_probe = rest.where("outside").withColumn("probe", F.lit(True)).withColumn("turn", F.pmod(F.xxhash64("band", "set_key"), F.col("turns")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        dealt = as_base.unionByName(as_probe).join(sets, "set_key").select(*keys, "turn", "probe", "set_key", "size", "root", its_sketch, "hashes")
        compared = dealt.repartition(*keys, "turn").sortWithinPartitions(*keys, "turn", "probe", "set_key").mapInArrow(lambda x: _compare(x, least), "a long, b long")
        found = found.unionByName(scratch.write(compared.distinct()))
    fp = owners.select("set_key", "fp")
    joined = found.join(fp.select(F.col("set_key").alias("a"), F.col("fp").alias("fa")), "a").join(fp.select(F.col("set_key").alias("b"), F.col("fp").alias("fb")), "b")
    return same.unionByName(joined.where("fa <> fb").select(F.col("fa").alias("a"), F.col("fb").alias("b"))).distinct()


def simhash_groups(docs: DataFrame, shingle: int = 4, half: int = 2, scratch: Scratch | None = None, least: float | None = None) -> DataFrame:
    """doc_id, row_key, fingerprint (16 hex digits), component_id (least doc_id of the component). With `least`, texts whose
    sets of shingles have at least that Jaccard similarity are linked too."""
    scratch = scratch or Scratch(docs.sparkSession)
    rows = scratch.write(fingerprints(docs, shingle) if least is None else signatures(docs, shingle))
    nodes = scratch.write(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    linked = links(nodes.select("fp"), scratch, half)
    if least is not None:
        linked = linked.unionByName(similar_links(docs, rows, scratch, shingle, least))
    roots = components(linked, scratch)
    placed = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    lowest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = scratch.write(placed.join(lowest, "root").select("fp", "n", "component_id"))
    return join_hot(rows, named, ["fp"]).select("doc_id", "row_key", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame, shingle: int = 5, half: int = 2, least: float | None = None) -> DataFrame:
    """The documents, with all their columns, but one of each component: that of the least doc_id (row_key breaks ties)."""
    scratch = Scratch(docs.sparkSession)
    groups = simhash_groups(docs, shingle, half, scratch, least)
    # Rows without an id can't share the null component id: each text of theirs stays by its fingerprint.
    key = F.coalesce(F.col("component_id").cast("string"), F.col("fingerprint"))
    (name,) = unused(docs, "_key")
    stay = groups.groupBy(key.alias("k")).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("s")).select(F.col("s.row_key").alias(name))
    stay = scratch.write(stay.distinct())
    keyed = docs.withColumn(name, F.xxhash64("doc_id", "text"))
    return keyed.join(stay, name, "left_semi").dropDuplicates([name]).drop(name)
