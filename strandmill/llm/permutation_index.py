"""Approximate nearest neighbours with a permutation index.

A vector is represented by the order of its `prefix` nearest pivots. Vectors are indexed in blocks; each block has one
inverted file a pivot, with the vectors that have it in their prefix and at which rank. A query's footrule distance is
the sum of rank differences over its own prefix, a pivot that a vector's prefix lacks being placed at rank 2 * `prefix`; it is
added up over the inverted files of the query's own pivots, and no others are read. The `share` of the block's vectors at the least
distance (and `DEEP` for each neighbour asked for, at least) is reranked by the exact inner product in double precision; a task goes
through its group of the blocks, of which there are `GROUPS`, and passes on its best, so that rows grow with the queries, not with the blocks.
Every row is indexed, equal vectors of a block as one entry; only the pivots are a bounded sample.

Largest inner product is turned into nearest distance for choosing pivots' order: vectors get one more component that
makes all their norms equal, queries have 0 there.

The queries are a stated set. A task has one block of `QUERY_BLOCK` queries and reads the index blocks of a group one after the other; each query is
shuffled `GROUPS` times, each index block once for a query block; memory is one index block, one query block and its best. `share` is a third as such vectors without clusters need it: in check_s, the nearest
neighbours of a query lie in half of all pivots' cells (measured: 0.91 of them in the nearest 256 of 512), so that cells can't be left out; measured recall
at 20 is 0.999 over 10,256 vectors of 64 components without clusters, 0.946 with a crowd of like vectors among them.

Defined cases: vectors that are null, zero, or hold null or non-finite components, vectors of another than the commonest
number of components, and rows without vec_id take no part. Fewer candidates than asked for are all returned. Ties go to
smaller vec_id. Of repeated rows each is a query and a candidate for the others. An empty table gives an empty result. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, partition_keys

PIVOTS, PREFIX, SHARE, DEEP = 512, 96, 0.33, 12
BLOCK, QUERY_BLOCK, GROUPS = 2_048, 4_096, 8
OUT = "query_uid long, query_id long, vec_id long, uid long, score double"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, uid, v (array<double>): the rows that take part."""
    rows = vectors.select("vec_id", F.monotonically_increasing_id().alias("uid"), F.col("embedding").cast("array<double>").alias("v"))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.coalesce(good, F.lit(False)))


def choose_pivots(rows: DataFrame, pivots: int) -> np.ndarray:
    """Different vectors of the rows with the least hashes; at most four times as many are looked at."""
    sample = rows.select("v", F.xxhash64("vec_id", "v").alias("h")).orderBy("h").limit(4 * pivots).collect()
    return np.array(list(dict.fromkeys(tuple(r.v) for r in sample))[:pivots])


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, extra: np.ndarray, pivot_extra: np.ndarray, prefix: int) -> np.ndarray:
    """For each row the numbers of its nearest pivots, nearest first. extra: the component that makes norms equal."""
    near = x @ pivots.T + np.outer(extra, pivot_extra)
    # Pivots' own norms are equal with their extra component, so the largest product is the nearest.
    return np.argsort(-near, axis=1, kind="stable")[:, :prefix]


def _extra(x: np.ndarray, norm2: float) -> np.ndarray:
    return np.sqrt(np.maximum(norm2 - (x * x).sum(1), 0))


def _blocks(batches: Iterator[pa.RecordBatch], pivots: np.ndarray, norm2: float, prefix: int, query: bool) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held).sort_by([("block", "ascending"), ("vec_id", "ascending"), ("uid", "ascending")])
    block = table.column("block").to_numpy()
    pivot_extra = _extra(pivots, norm2)
    for k in np.unique(block):
        lo, hi = np.searchsorted(block, [k, k + 1])
        part = table.slice(lo, hi - lo)
        x = _matrix(part.column("v"))
        order = nearest_pivots(x, pivots, np.zeros(len(x)) if query else _extra(x, norm2), pivot_extra, prefix)
        ids, uids = part.column("vec_id").to_numpy(), part.column("uid").to_numpy()
        if query:
            data = (ids, uids, x, order.astype(np.int32))
        else:
            # Equal vectors are one entry of the inverted files, so that a crowd of copies takes one candidate's place.
            _, first, entry = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel(), return_index=True, return_inverse=True)
            members = np.argsort(entry, kind="stable")  # by entry, then vec_id
            x, order, ids, uids = x[first], order[first], ids[members], uids[members]
            begin = np.searchsorted(entry[members], np.arange(len(first) + 1))
            post = np.argsort(order.ravel(), kind="stable")
            data = (ids, uids, begin, x, (post // order.shape[1]).astype(np.int32), (post % order.shape[1]).astype(np.int16), np.searchsorted(order.ravel()[post], np.arange(len(pivots) + 1)))
        yield pa.RecordBatch.from_arrays([pa.array([int(k)], pa.int32()), pa.array([pickle.dumps(data, 5)], pa.binary())], ["block", "blob"])


def candidates(order: np.ndarray, rows: np.ndarray, ranks: np.ndarray, at: np.ndarray, n: int, most: int) -> np.ndarray:
    """The `most` rows of a block that agree most with a query's pivot order; ties go to the first."""
    if most >= n:
        return np.arange(n)
    prefix = len(order)
    files = [slice(at[p], at[p + 1]) for p in order.tolist()]
    rank = np.repeat(np.arange(prefix), at[order + 1] - at[order])
    nearer = 2 * prefix - rank - np.abs(np.concatenate([ranks[f] for f in files]) - rank)
    # How much nearer each row is than one without any of the query's pivots.
    total = np.bincount(np.concatenate([rows[f] for f in files]), weights=nearer, minlength=n)
    least = np.partition(total, n - most)[n - most]
    sure = np.flatnonzero(total > least)
    return np.sort(np.concatenate((sure, np.flatnonzero(total == least)[: most - len(sure)])))


def best(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the k largest inner products, ties to smaller ids, and the products."""
    rough = x @ q
    if len(rough) > k:
        margin = 1e-9 * (1 + np.abs(rough).max())
        near = np.flatnonzero(rough >= np.partition(rough, len(rough) - k)[len(rough) - k] - margin)
    else:
        near = np.arange(len(rough))
    exact = (x[near] * q).sum(1)
    order = np.lexsort((ids[near], -exact))[:k]
    return near[order], exact[order]


def _search(batches: Iterator[pa.RecordBatch], k: int, share: float) -> Iterator[pa.RecordBatch]:
    """The k best of each query of a task (a key's first row) in all index blocks of the task (the rows after it)."""
    key, queries, held = None, None, []

    def flush() -> Iterator[pa.RecordBatch]:
        if held:
            n = [len(h[0]) for h in held]
            vec_id, uid, score = (np.concatenate(x) for x in zip(*held, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.repeat(queries[1], n), np.repeat(queries[0], n), vec_id, uid, score)], ["query_uid", "query_id", "vec_id", "uid", "score"])

    for b in batches:
        for own, block, blob in zip(b.column("key").to_pylist(), b.column("block").to_pylist(), b.column("blob"), strict=True):
            if own != key:
                yield from flush()
                key, queries, held = own, None, []
            if block < 0:
                queries = pickle.loads(blob.as_py())
                held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))] * len(queries[0])
                continue
            if queries is None:
                continue
            ids, uids, begin, x, rows, ranks, at = pickle.loads(blob.as_py())
            most = max(DEEP * k, int(np.ceil(share * len(x))))
            size = np.minimum(np.diff(begin), k + 1)  # of equal vectors no more than k besides the query itself can be among the k nearest
            for i, (q_uid, q, order) in enumerate(zip(queries[1].tolist(), *queries[2:], strict=True)):
                entries = candidates(order, rows, ranks, at, len(x), most)
                n = size[entries]
                found = np.repeat(begin[entries] - np.cumsum(n) + n, n) + np.arange(n.sum())
                entries = np.repeat(entries, n)[uids[found] != q_uid]
                found = found[uids[found] != q_uid]
                place, score = best(q, x[entries], ids[found], k)
                place = found[place]
                all_ids, all_uids, all_scores = (np.concatenate(c) for c in zip(held[i], (ids[place], uids[place], score), strict=True))
                first = np.lexsort((all_uids, all_ids, -all_scores))[:k]
                held[i] = (all_ids[first], all_uids[first], all_scores[first])
    yield from flush()


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, pivots: int = PIVOTS, prefix: int = PREFIX, share: float = SHARE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose vec_id is divisible by `every`."""
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows = scratch.write(usable(vectors).withColumn("size", F.size("v")))
    sizes = rows.groupBy("size").count().orderBy(F.desc("count"), "size").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.col("size") == sizes[0]["size"]).drop("size")
    is_query = F.col("vec_id") % every == 0
    n, n_queries, norm2 = rows.agg(F.count("*"), F.count_if(is_query), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).first()
    chosen = choose_pivots(rows, pivots)

    def blocks(of: DataFrame, parts: int, query: bool) -> DataFrame:
        dealt = of.withColumn("block", F.pmod(F.xxhash64("uid"), F.lit(parts)).cast("int"))
        return scratch.write(dealt.repartition(parts, "block").mapInArrow(lambda x: _blocks(x, chosen, norm2, min(prefix, len(chosen)), query), "block int, blob binary"))

    parts = max(1, -(-n // BLOCK))
    index = blocks(rows, parts, False)
    asked = blocks(rows.where(is_query), max(1, -(-n_queries // QUERY_BLOCK)), True)
    groups, asked_parts = min(GROUPS, parts), max(1, -(-n_queries // QUERY_BLOCK))
    keys = F.array(*[F.lit(int(x)) for x in partition_keys(groups * asked_parts)])
    task = lambda query_block, group: F.element_at(keys, (query_block * groups + group + 1).cast("int")).alias("key")
    of_queries = asked.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select(task(F.col("block"), F.col("group")), F.lit(-1).alias("block"), "blob")
    of_index = index.withColumn("for", F.explode(F.sequence(F.lit(0), F.lit(asked_parts - 1)))).select(task(F.col("for"), F.pmod("block", F.lit(groups))), "block", "blob")
    dealt = of_queries.unionByName(of_index).repartition(groups * asked_parts, "key").sortWithinPartitions("key", "block")
    found = dealt.mapInArrow(lambda x: _search(x, k, share), OUT)
    w = Window.partitionBy("query_uid").orderBy(F.desc("score"), "vec_id", "uid")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
