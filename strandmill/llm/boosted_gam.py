"""Quality classifier: a generalised additive model with pairwise interactions.

Every text gets numeric features, from its bytes and lines alone. Each feature is cut into at most `BINS` bins at quantiles.
Cyclic boosting visits feature after feature; each time a shallow regression tree (three leaves at most) on that
feature's bins is fitted to the gradient and added, shrunk, to the feature's lookup table. When the main effects are done,
the pairs that explain most of what remains get two-way tables in the same way, by trees that cut both features once. A text's score is
the logistic function of the intercept plus one table entry a feature and pair: vectorised bin look-ups and additions.

Fitting uses a bounded sample: the `SAMPLE` rows of labels with the least hashes of doc_id among those whose
crc32(doc_id) mod 4 is not 2. It runs on the driver over SAMPLE x features numbers; the model (a few kB) goes to the tasks.
lang, source, doc_id and labels are no features.

Defined cases: a null text is empty, and has a score like any other. Rows with a null label or id don't train; if nothing
can train, or one class only, every score is that class's share (0.5 without rows). Repeated rows are scored each; of
repeated labels each counts, and of several texts with a label's id the one with the least features trains. Of equally good
splits and pairs the first is taken. A very long text is one row like any other. An empty table gives an empty result. Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, text_or_empty

SAMPLE, BINS, PAIRS = 20_000, 32, 10
ROUNDS, PAIR_ROUNDS, RATE, LEAST_LEAF = 200, 60, 0.1, 15
THRESHOLD = 0.7
FEATURES = (
    "log_bytes", "log_words", "word_bytes", "upper", "digit", "space", "newline", "non_ascii", "symbol", "pipe", "stop", "exclaim", "comma", "other_punct",
    "long_words", "short_words", "repeat_words", "dup_lines", "line_words", "upper_words", "entropy", "repeat_pairs",
)
_CLASS = np.zeros(256, np.int64)
for _k, _chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\v\f", "\n", "", "#*$%&<>@^~_=+{}[]\\/", "|", ".", "!?", ",;:", "\"'()-`"), 1):
    for _c in _chars:
        _CLASS[ord(_c)] = _k
_CLASS[128:] = 5
CLASSES = 12


def features(text: str) -> list[float]:
    data = text.encode("utf-8", "surrogatepass")
    n = len(data)
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    by_class = np.bincount(_CLASS, weights=count, minlength=CLASSES)
    words = data.split()
    w = max(len(words), 1)
    lines = [x for x in data.split(b"\n") if x.strip()]
    share = count[count > 0] / max(n, 1)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    pairs = set(zip(words, words[1:], strict=False))
    return [
        np.log1p(n), np.log1p(len(words)), (n + 120) / (w + 20), *(100 * by_class[[1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11]] / (n + 20)).tolist(),
        float((sizes > 14).sum()) / (w + 10), float((sizes < 3).sum()) / (w + 10), 1 - (len(set(words)) + 10) / (w + 10), (len(lines) - len(set(lines))) / (len(lines) + 3),
        np.log1p(w / max(len(lines), 1)), sum(map(bytes.isupper, words)) / (w + 10), float(-(share * np.log2(share)).sum()), 1 - (len(pairs) + 10) / (w + 9),
    ]


class Model:
    """Cuts for each feature, a table for each feature, and a table for each pair."""

    def __init__(self, base: float, cuts: list[np.ndarray], tables: list[np.ndarray], pairs: list[tuple[int, int, np.ndarray]]):
        self.base, self.cuts, self.tables, self.pairs = base, cuts, tables, pairs

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)], 1) if len(x) else np.zeros((0, len(self.cuts)), np.int64)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        f = np.full(len(x), self.base)
        for j, t in enumerate(self.tables):
            f += t[b[:, j]]
        for i, j, t in self.pairs:
            f += t[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-np.clip(f, -30, 30)))


def _leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, leaves: int = 3) -> np.ndarray:
    """Leaf values by bin: splits a range of bins where the gain is largest, then again. g, h, n: sums by bin."""
    parts = [(0, len(g))]
    cg, ch, cn = (np.concatenate(([0], np.cumsum(v))) for v in (g, h, n))
    while len(parts) < leaves:
        best = (1e-9, 0, 0)
        for p, (a, b) in enumerate(parts):
            if b - a < 2:
                continue
            cut = np.arange(a + 1, b)
            gl, hl, nl = cg[cut] - cg[a], ch[cut] - ch[a], cn[cut] - cn[a]
            gr, hr, nr = cg[b] - cg[cut], ch[b] - ch[cut], cn[b] - cn[cut]
            gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - (gl + gr) ** 2 / (hl + hr + 1)
            gain[(nl < LEAST_LEAF) | (nr < LEAST_LEAF)] = -1
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), p, int(cut[k]))
        if not best[2]:
            break
        a, b = parts.pop(best[1])
        parts += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = _leaf(cg[b] - cg[a], ch[b] - ch[a])
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut of both features at once: its gain, and the values of its four quadrants by pair of bins."""
    sums = [np.pad(np.cumsum(np.cumsum(v, 0), 1), ((1, 0), (1, 0))) for v in (g, h, n)]
    best, value = 0.0, np.zeros(g.shape)
    rows, cols = np.arange(1, g.shape[0]), np.arange(1, g.shape[1])
    if not len(rows) or not len(cols):
        return best, value
    quads = []
    for s in sums:
        a = s[np.ix_(rows, cols)]
        top, left, total = s[rows, -1][:, None], s[-1, cols][None, :], s[-1, -1]
        quads.append((a, top - a, left - a, total - top - left + a))
    gain = sum(q**2 / (w + 1) for q, w in zip(quads[0], quads[1], strict=True)) - sums[0][-1, -1] ** 2 / (sums[1][-1, -1] + 1)
    gain = np.where(np.minimum.reduce(quads[2]) < LEAST_LEAF, -1.0, gain)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    best = float(gain[i, j])
    if best <= 0:
        return 0.0, value
    v = [_leaf(q[i, j], w[i, j]) for q, w in zip(quads[0], quads[1], strict=True)]
    r, c = int(rows[i]), int(cols[j])
    value[:r, :c], value[:r, c:], value[r:, :c], value[r:, c:] = v
    return best, value


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    share = float(y.mean()) if len(y) else 0.5
    flat = Model(float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))), [np.zeros(0)] * len(FEATURES), [np.zeros(1)] * len(FEATURES), [])
    if share in (0.0, 1.0) or not len(y):
        flat.base = float(np.clip(flat.base, -20, 20))
        return flat
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="higher")) for j in range(x.shape[1])]
    model = Model(flat.base, cuts, [np.zeros(len(c) + 1) for c in cuts], [])
    b = model.bins(x)
    f = np.full(len(y), model.base)

    def gradient() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j, table in enumerate(model.tables):
            g, h = gradient()
            size = len(table)
            step = RATE * _tree(*(np.bincount(b[:, j], weights=v, minlength=size) for v in (g, h, np.ones(len(y)))))
            table += step
            f += step[b[:, j]]

    def sums(i: int, j: int) -> list[np.ndarray]:
        g, h = gradient()
        shape = len(model.tables[i]), len(model.tables[j])
        return [np.bincount(b[:, i] * shape[1] + b[:, j], weights=v, minlength=shape[0] * shape[1]).reshape(shape) for v in (g, h, np.ones(len(y)))]

    ranked = sorted(((_quadrants(*sums(i, j))[0], i, j) for i, j in combinations(range(x.shape[1]), 2)), key=lambda r: (-r[0], r[1:]))
    model.pairs = [(i, j, np.zeros((len(model.tables[i]), len(model.tables[j])))) for gain, i, j in ranked[:PAIRS] if gain > 0]
    for _ in range(PAIR_ROUNDS):
        for i, j, table in model.pairs:
            step = RATE * _quadrants(*sums(i, j))[1]
            table += step
            f += step[b[:, i], b[:, j]]
    return model


def _matrix(texts: pa.Array) -> np.ndarray:
    return np.array([features(t.as_py()) for t in texts]).reshape(-1, len(FEATURES))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = _matrix(b.column("text"))
        yield pa.RecordBatch.from_arrays([b.column("label"), b.column("quality"), pa.array(list(x), pa.list_(pa.float64()))], ["label", "quality", "x"])


def remainder(mod: int):
    """crc32 of the id as text, mod a number."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    scratch = Scratch(docs.sparkSession)
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (remainder(4) != 2)).select("doc_id", F.col("quality").cast("double").alias("quality"))
    # Bounded by `sample`, so it may be broadcast.
    chosen = scratch.write(usable.orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id", "quality").limit(sample).withColumn("label", F.monotonically_increasing_id()))
    rows = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id").select("label", "quality", "text")
    by_label = rows.mapInArrow(_features, "label long, quality double, x array<double>").groupBy("label").agg(F.min("quality").alias("quality"), F.min("x").alias("x"))
    got = by_label.orderBy("label").collect()  # a row a label of the sample at most
    return fit(np.array([r.x for r in got]).reshape(-1, len(FEATURES)), np.array([r.quality for r in got]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score(_matrix(b.column("text")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32), pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    return score(docs, train(docs, labels))


def crc(doc_id: int, mod: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % mod
