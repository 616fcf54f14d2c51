"""Document operators against brute force, on tables with nulls, blanks, repeats, ties and clashing columns."""

import hashlib
import math
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from strandmill.llm import bin_completion, boosted_gam, bwt_dedup, context_tree, entropy_mix, robust_outliers, simhash_ball

from .helpers import OWN, WORD, documents, lower, prose

OPERATORS = {
    "op1": robust_outliers.robust_outliers, "op2": context_tree.score, "op4": entropy_mix.mix, "op6": bin_completion.pack_documents, "op9": simhash_ball.simhash_groups, "op10": bwt_dedup.digest,
    "keep": robust_outliers.keep, "dedup": simhash_ball.near_dedup, "strip": bwt_dedup.strip, "resample": entropy_mix.resample,
    "strip_words": bwt_dedup.strip_words,
}


@pytest.mark.parametrize("name", ["dedup", "keep", "resample", "strip", "strip_words"])
def test_other_columns_keep_their_values(spark, name):
    df = documents(spark)
    got = OPERATORS[name](df)
    assert got.dtypes == df.dtypes and got.count() > 10
    assert {str(tuple(r)[4:]) for r in got.collect()} == {str(OWN)}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(spark, name):
    assert OPERATORS[name](documents(spark, [])).collect() == []


def test_outlier_rules(spark):
    df = documents(spark)
    rows = {(r.doc_id, r.text): r for r in df.collect()}
    got = robust_outliers.robust_outliers(df).collect()
    assert len(got) == df.count()
    by_id = {r.doc_id: r for r in got}
    for (doc_id, text), _ in rows.items():
        w = WORD.findall(text or "")
        windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        n = Counter(windows)
        repeated = {p for i, x in enumerate(windows) if n[x] > 1 for p in range(i, i + 5)}
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        r = by_id[doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated))
        assert r.base_failed == (len(w) < 10 or 100 * len(repeated) > 20 * len(w)) and not (r.base_failed and r.kept)
    assert sorted(map(str, robust_outliers.keep(df).collect())) == sorted(str(r) for r in df.collect() if by_id[r.doc_id].kept)


def _mcd(x):
    """The same estimate with plain numpy, from exact sums and the same distance classes, each start until its determinant falls no further."""
    floors = np.diag([(f * 1000) ** 2 for f in robust_outliers.FLOORS])

    def fit(rows, factor):
        m = rows.mean(0)
        return m, (rows.T @ rows / len(rows) - np.outer(m, m)) * factor + floors

    def d2(m, c):
        return np.einsum("ij,ij->i", (x - m) @ np.linalg.inv(c), x - m)

    step = 10
    q = [[sorted(np.floor(x[:, j] / step) * step)[math.ceil(s * len(x)) - 1] for j in range(5)] for s in (0.25, 0.5, 0.75)]
    ended = []
    for m, c in [(np.array(q[1], float), np.diag((np.subtract(q[2], q[0]) / 1.349) ** 2) + floors), fit(x, 1.0)]:
        before = math.inf
        while True:
            b = np.clip(np.floor((np.log(d2(m, c) + 1e-6) + 14) * robust_outliers.BINS_PER_UNIT), 0, robust_outliers.BINS - 1)
            last = next(v for v in sorted(set(b)) if (b <= v).sum() >= 0.75 * len(x))
            m, c = fit(x[b <= last], robust_outliers.CONSISTENCY_75)
            now = np.linalg.slogdet(c)[1] / 2
            if now > before - robust_outliers.SETTLED:
                break
            before = now
        ended.append((now, m, c))
    _, m, c = min(ended, key=lambda e: e[0])
    m, c = fit(x[d2(m, c) <= robust_outliers.CHI2_5_0975], 1.0)
    return d2(m, c)


def test_outlier_distances_match_plain_mcd(spark):
    rng = random.Random(4)
    good = [prose(rng, rng.randrange(20, 200)) for _ in range(150)]
    bad = [" ".join(w + "###" for w in prose(rng, 60).split()) for _ in range(12)]
    df = spark.createDataFrame([(k, t, "en", "s") for k, t in enumerate(good + bad)], "doc_id long, text string, lang string, source string").repartition(5)
    got = {r.doc_id: r for r in robust_outliers.robust_outliers(df).collect()}
    stats = {r.doc_id: [r[c] for c in robust_outliers.STATS] for r in robust_outliers.statistics(robust_outliers.base_counts(df)).collect()}
    order = sorted(k for k in got if not got[k].base_failed)
    want = _mcd(np.array([stats[k] for k in order], float))
    assert np.allclose([got[k].distance for k in order], want, rtol=1e-6, atol=1e-6)
    assert all(got[k].kept for k in range(150)) and not any(got[150 + k].kept for k in range(12))


def _fingerprint(text, shingle):
    w = WORD.findall(lower(text))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + shingle]).encode(), 42) for i in range(max(1, len(w) - shingle + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_groups(spark):
    df = documents(spark)
    rows = df.collect()
    fps = [_fingerprint(r.text, 4) for r in rows]
    root = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (fps[i] ^ fps[j]).bit_count() <= 4 and root[j] < root[i]:
                    root[i], changed = root[j], True
    least = defaultdict(list)
    for k, r in enumerate(rows):
        if r.doc_id is not None:
            least[root[k]].append(r.doc_id)
    want = sorted((str(r.doc_id), f"{f:016x}", str(min(least[root[k]], default=None))) for k, (r, f) in enumerate(zip(rows, fps, strict=True)))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash_ball.simhash_groups(df).collect()) == want


def test_ball_links_connect_all_within_four_bits(spark):
    rng = random.Random(2)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for f in list(fps):
        for _ in range(3):
            for b in rng.sample(range(64), rng.randrange(1, 6)):
                f ^= 1 << b
            fps.add(f)
    signed = [f - (1 << 64) if f >> 63 else f for f in sorted(fps)]
    from strandmill.llm.common import Scratch
    from strandmill.llm.components import components

    scratch = Scratch(spark)
    found = {r.node: r.root for r in components(simhash_ball.links(spark.createDataFrame([(f,) for f in signed], "fp long"), scratch), scratch).collect()}
    near = {(a, b) for a in signed for b in signed if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4}
    group = {a: a for a in signed}
    for _ in range(len(signed)):
        new = {a: min(group[b] for b in signed if (a, b) in near) for a in signed}
        if new == group:
            break
        group = new
    assert {a: found.get(a, a) for a in signed} == group


def test_near_dedup_keeps_one_of_each_group(spark):
    df = documents(spark)
    kept = simhash_ball.near_dedup(df)
    assert kept.columns == df.columns
    texts = Counter(r.text for r in kept.collect())
    assert max(texts.values()) == 1 and all(lower(t).strip() for t in texts if t is not None and t.strip())
    groups = {r.component_id for r in simhash_ball.simhash_groups(df, 5).collect()}
    assert kept.count() == len(groups)


def test_near_dedup_reaches_similarity(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts = []
    for n in range(60, 180, 3):
        w = [word() for _ in range(n)]
        texts.append(" ".join(w))
        for edits in (1, 2, 3):
            own = list(w)
            for k in range(edits):
                own[(k + 1) * n // (edits + 1)] = word()
            texts.append(" ".join(own))
    texts += [texts[0] + " " + texts[0], "", None, "two words"]
    sets = [{tuple((t or "").split()[i : i + 5]) for i in range(max(1, len((t or "").split()) - 4))} for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and root[i] != root[j]:
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in simhash_ball.near_dedup(df, least=0.8).collect()) == sorted(set(root))


@pytest.mark.parametrize("part", [4096, 20])
def test_crowds_of_near_copies_are_linked_without_all_pairs(spark, monkeypatch, part):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    origin, texts = [word() for _ in range(146)], []
    for k in range(240):
        own = list(origin)
        for _ in range(k % 9):
            own[rng.randrange(len(own))] = word()
        texts.append(" ".join(own[: 146 - k % 5]))
    texts += [" ".join(origin[:n]) for n in (20, 24, 32, 33, 40, 110, 128, 129, 140)]  # across levels
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    similar = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert 1000 < len(similar) < 0.6 * len(texts) ** 2 / 2  # links hold, but not between all
    checked = []
    monkeypatch.setattr(simhash_ball, "PART_SETS", part)
    verified = simhash_ball._verified
    monkeypatch.setattr(simhash_ball, "_verified", lambda sets, pairs, least: checked.append(pairs.count()) or verified(sets, pairs, least))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    scratch = simhash_ball.Scratch(spark)
    rows = scratch.write(simhash_ball.signatures(df, 5))
    fp = {r.doc_id: r.fp for r in rows.collect()}
    got = [(r.a, r.b) for r in simhash_ball.similar_links(df, rows, scratch, 5, 0.8).collect()]

    def roots(links):
        root = {x: x for x in fp.values()}
        for a, b in links:
            low, high = sorted((root[a], root[b]))
            root = {x: low if r == high else r for x, r in root.items()}
        return root

    assert roots(got) == roots((fp[i], fp[j]) for i, j in similar)
    assert sum(checked) < 0.25 * len(texts) ** 2 / 2


def test_sketches_never_rule_out_similar_sets():
    rng = np.random.default_rng(4)
    for n in (1, 2, 5, 13, 64, 65, 700):
        x = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
        for gone in range(0, n, max(1, n // 12)):
            y = np.unique(np.concatenate([x[gone:], rng.integers(0, 1 << 63, gone // 2, np.uint64)]))
            if simhash_ball.alike(x.tobytes(), y.tobytes(), 0.8):
                k = max(simhash_ball.level(len(x)), simhash_ball.level(len(y)))
                assert all(k <= simhash_ball.level(simhash_ball.top_size(len(s), 0.8)) for s in (x, y))
                a, b = (np.frombuffer(simhash_ball.sketch(s, k), "<u8") for s in (x, y))
                assert simhash_ball.distances(np.array([len(x)]), a[None], len(y), b)[0] <= simhash_ball.most_apart(0.8)


def _removed(texts, length):
    data = [(t or "").encode() for t in texts]
    n = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if n[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


@pytest.mark.parametrize("length", [16, 40, 400])
def test_repeated_passages(spark, length):
    df = documents(spark)
    rows = df.collect()
    want = _removed([r.text for r in rows], length)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in bwt_dedup.digest(df, length).collect())
    assert got == sorted((str(r.doc_id), *w[:4]) for r, w in zip(rows, want, strict=True))
    stripped = bwt_dedup.strip(df, length)
    assert stripped.columns == df.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in stripped.collect()) == sorted((str(r.doc_id), "None" if r.text is None else w[4].decode("utf-8", "ignore")) for r, w in zip(rows, want, strict=True))


def test_passages_within_one_document_stay(spark):
    rng = random.Random(14)
    fresh = lambda n: " ".join(f"{rng.randrange(10**5)}" for _ in range(n))
    twice, short, long_ = fresh(60), fresh(55), fresh(70)
    texts = [f"{twice} {fresh(5)} {twice}", f"{fresh(9)} {short} {fresh(9)}", f"{short} {fresh(30)}", f"{long_} {fresh(3)} {long_}", long_, "plain words"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.text for r in bwt_dedup.strip_words(df).collect()}
    assert len(short.encode()) < 400 and got[0] == texts[0] and got[5] == texts[5]
    assert [len(got[k].split()) for k in (1, 2, 3, 4)] == [18, 30, 3, 0]


def test_repeated_words(spark):
    rng = random.Random(8)
    fresh = lambda n: [f"{rng.randrange(10**5)}" for _ in range(n)]
    long_, short, letters = prose(rng, 51).split(), fresh(50), [rng.choice("abcdefghij") for _ in range(51)]
    texts = [fresh(7) + long_ + fresh(9), fresh(60) + long_, fresh(8) + short + fresh(30), short + fresh(40), letters + fresh(3), fresh(4) + letters, ["é"] * 60]
    rows = [" ".join(t) for t in texts] + ["\n".join(fresh(2)) + "\t" + " \n ".join(long_), None, "", *[r.text for r in documents(spark).collect()]]
    words = [(t or "").encode().split() for t in rows]
    n = Counter(x for w in words for x in {tuple(w[i : i + 51]) for i in range(len(w) - 50)})
    n.subtract(x for x in {tuple(rows[9].encode().split()[i : i + 51]) for i in range(len(rows[9].split()) - 50)})
    want = []
    for w in words:
        gone = {k for i in range(len(w) - 50) if n[tuple(w[i : i + 51])] > 1 for k in range(i, i + 51)}
        want.append(b" ".join(x for k, x in enumerate(w) if k not in gone).decode())
    df = spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.text for r in bwt_dedup.strip_words(df).collect()}
    assert got[8] is None and got[2] == rows[2] and got[3] == rows[3]
    assert [b" ".join((got[k] or "").encode().split()).decode() for k in range(len(rows))] == want
    assert len(want[0].split()) == 16 and len(want[2].split()) == 88 and len(want[4].split()) == 3


def test_long_texts_are_cut_without_loss(spark, monkeypatch):
    rng = random.Random(9)
    long_ = "".join(rng.choice("abcdé ") for _ in range(9000))
    texts = [long_, "x" + long_[2000:2900], long_[8000:] + "y" * 900]
    monkeypatch.setattr(bwt_dedup, "PIECE_BYTES", 1500)
    pieces = [(k, at, p) for k, t in enumerate(texts) for at, p in bwt_dedup._pieces(t.encode(), 400)]
    routes, blobs = bwt_dedup._shard([(k, 0, at, p) for k, at, p in pieces], 1, 400)
    import pyarrow as pa

    out = list(bwt_dedup._reduce(iter([pa.RecordBatch.from_arrays([pa.array(routes, pa.int32()), pa.array(blobs, pa.binary())], ["reducer", "blob"])]), 400))
    spans = {k: bwt_dedup.merged(x, y) for b in out for k, x, y in zip(b.column("k1").to_pylist(), b.column("first").to_pylist(), b.column("past").to_pylist(), strict=True)}
    for k, w in enumerate(_removed(texts, 400)):
        assert bwt_dedup.without(texts[k].encode(), spans.get(k, [])) == w[4]


def test_entropy_mix(spark):
    rng = random.Random(6)
    rows = [(k, prose(rng, rng.randrange(1, 300)), rng.choice(["a"] * 6 + ["b", "ç", None])) for k in range(400)] + [(1000, None, "a"), (1001, "", "empty"), (1002, "w " * 9, "zz")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = entropy_mix.mix(df).collect()
    assert sorted(map(str, got)) == sorted(map(str, entropy_mix.mix(df.repartition(2)).collect()))
    size = Counter()
    for _, t, s in rows:
        size[s] += len(WORD.findall(t or ""))
    names = sorted((s for s in size if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, full = sum(size.values()), set()
    while True:
        left = total - sum(3 * size[s] for s in full)
        share = {s: 3 * size[s] if s in full else left * weight[s] / sum(weight[x] for x in names if x not in full) for s in names}
        over = {s for s in names if s not in full and share[s] > 3 * size[s]}
        if not over:
            break
        full |= over
    taken, biggest = Counter(), Counter()
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(share[r.source]) and 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
        biggest[r.source] = max(biggest[r.source], r.size)
    for s in names:
        assert abs(taken[s] - share[s]) <= biggest[s]
    for s in ("a", "b"):  # rates balance the tokens, and are exponential in the size
        own = [r for r in got if r.source == s and r.size]
        assert sum(r.rate * r.size for r in own) == pytest.approx(share[s], abs=2 * entropy_mix.NEAR)
        tilt = {math.log(r.rate) / r.size for r in own if r.rate < 3}
        assert max(tilt) - min(tilt) < 1e-9 and len({r.rate for r in own}) > 20


def test_resample_takes_what_mix_takes(spark):
    df = documents(spark)
    planned = {}
    for r in entropy_mix.mix(df).collect():
        planned.setdefault(r.doc_id, []).append(r.copies)
    assert len(planned[0]) == 2 and len(set(planned[0])) == 1  # the repeated row has the rate of its own size
    got = Counter(r.doc_id for r in entropy_mix.resample(df).collect())
    assert got == Counter({k: sum(v) for k, v in planned.items() if sum(v)})
    assert all(t is not None and WORD.search(t) for (t,) in entropy_mix.resample(df).select("text").collect())


def test_context_tree(spark):
    df = documents(spark)
    rows = df.collect()
    tokens = [WORD.findall(lower(r.text)) + [""] for r in rows]
    held = [r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 2 for r in rows]
    c = Counter(w for t, h in zip(tokens, held, strict=True) if not h for w in t)
    n, v = sum(c.values()), len(c)
    depth = context_tree.DEPTH
    streams = [" ".join([*t[:-1], "\n"]).encode() for t in tokens]
    code = context_tree.Code(np.bincount(np.frombuffer(b"".join(x for x, h in zip(streams, held, strict=True) if not h), np.uint8), minlength=256))
    assert sum(2.0 ** -len(p) for p in code.path) == 1 and len({tuple(p) for p in code.path}) == 256

    def events(x):
        full = b"\n" * depth + x
        for i, sym in enumerate(x):
            for node, bit in code.path[sym]:
                yield full[i : i + depth], node, bit

    count, kids = defaultdict(lambda: [0, 0]), defaultdict(set)
    for x, h in zip(streams, held, strict=True):
        for ctx, node, bit in events(x) if not h else ():
            for d in range(depth + 1):
                count[ctx[depth - d :], node][bit] += 1
    for ctx, node in count:
        if ctx:
            kids[ctx[1:], node].add((ctx, node))
    lg, memo = math.lgamma, {}

    def weighted(s):
        if s not in memo:
            a, b = count[s]
            own = lg(a + 0.5) + lg(b + 0.5) - lg(a + b + 1) - 2 * lg(0.5)
            below = sum(weighted(x)[0] for x in kids[s]) if s in kids else own
            memo[s] = (np.logaddexp(own, below) - math.log(2) if s in kids else own, own, below)
        return memo[s]

    def one(ctx, node):
        p = None
        for d in range(depth, -1, -1):
            s = (ctx[depth - d :], node)
            if s in count:
                a, b = count[s]
                estimate = (b + 0.5) / (a + b + 1)
                w = 1 / (1 + math.exp(min(700, weighted(s)[2] - weighted(s)[1])))
                p = estimate if p is None else w * estimate + (1 - w) * p
        return 0.5 if p is None else p

    def code_length(x):
        return sum(math.log10(one(ctx, k) if b else 1 - one(ctx, k)) for ctx, k, b in events(x))

    want = sorted((str(r.doc_id), h, len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 5), code_length(x), len(x)) for r, t, h, x in zip(rows, tokens, held, streams, strict=True))
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), r.score, r.bits_per_byte) for r in context_tree.score(df).collect())
    assert [g[:6] for g in got] == [w[:6] for w in want]
    assert np.allclose([g[6] for g in got], [w[6] for w in want], rtol=1e-5)
    assert np.allclose([g[7] for g in got], [-w[6] * math.log2(10) / w[7] for w in want], rtol=1e-5)


def test_word_order_matters(spark):
    rng = random.Random(21)
    phrase = [prose(rng, 1) for _ in range(9)]
    rows = [(k, " ".join(phrase * 8)) for k in range(60)]
    turned = phrase[::-1]
    df = spark.createDataFrame([*rows, (100, " ".join(phrase * 2)), (101, " ".join(turned * 2))], "doc_id long, text string")
    got = {r.doc_id: r for r in context_tree.score(df).collect()}
    assert got[100].base_score == pytest.approx(got[101].base_score) and got[100].score > got[101].score + 5


def test_batches_and_shards_change_nothing(spark, monkeypatch):
    df = documents(spark)
    want = {(r.doc_id, r.n_tokens, r.n_known): r.score for r in context_tree.score(df).collect()}
    for name, value in (("BATCH_BYTES", 500), ("GRAM_SHARD_BYTES", 2_000), ("WORD_SHARD_BYTES", 5_000), ("PART", 50)):
        monkeypatch.setattr(context_tree, name, value)
    got = {(r.doc_id, r.n_tokens, r.n_known): r.score for r in context_tree.score(df).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-6) for k in want)


def test_scoring_a_batch_takes_little_memory():
    rng = random.Random(6)
    texts = [" ".join(rng.choice(("alpha", "beta", "gamma", "delta", "eps")) + str(rng.randrange(300)) for _ in range(2000)).encode() for _ in range(300)]
    batch, keys = context_tree._Batch(texts), np.arange(3)
    asked = {shard: blob for shard, blob, _ in batch.ask(np.ones(len(texts), bool), keys, keys)}
    split = context_tree.len_words(keys)
    every, n = context_tree.distinct_grams(batch.streams)
    assert n.sum() == sum(map(len, batch.streams)) and sorted(set(context_tree.grams(batch.streams).tolist())) == every.tolist()
    value = lambda gram: (gram % np.uint64(1009)).astype("<f4")
    answers = {s: context_tree._squeeze(value(context_tree._unplane(context_tree._expand(b)[0])).tobytes()) if s < split else context_tree._squeeze(*context_tree._expand(b)[1:]) for s, b in asked.items()}
    tracemalloc.start()
    score = batch.scores(answers, 3, 3)[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(score, [value(context_tree.grams([s])).astype(float).sum() for s in batch.streams])
    assert peak < (4 << context_tree.SLOT_BITS) + 20 * sum(map(len, batch.streams))


def test_a_batch_of_many_words_takes_little_memory():
    rng = random.Random(7)
    texts = [" ".join(f"{rng.randrange(1 << 40):x}"[: rng.randrange(2, 8)] for _ in range(4000)).encode() for _ in range(200)]
    train, keys, size = np.arange(len(texts)) % 7 != 2, np.arange(3), sum(map(len, texts))

    def peak(work):
        tracemalloc.start()
        got = work(context_tree._Batch(texts))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return got, most

    asked, most = peak(lambda batch: list(batch.ask(train, keys, keys)))
    assert most < 64 * size
    split = context_tree.len_words(keys)
    answers = {s: context_tree._squeeze(np.ones(len(context_tree._unplane(context_tree._expand(b)[0])), "<f4").tobytes()) if s < split else context_tree._squeeze(*context_tree._expand(b)[1:]) for s, b, _ in asked}
    (score, known, base), most = peak(lambda batch: batch.scores(answers, 3, 3))
    assert most < (4 << context_tree.SLOT_BITS) + 54 * size
    count = Counter(w for t, x in zip(texts, train, strict=True) if x for w in context_tree.stream(t)[0])
    tokens = [context_tree.stream(t)[0] for t in texts]
    assert score.tolist() == [len(context_tree.stream(t)[1]) for t in texts] and known.tolist() == [sum(count[w] > 0 for w in t) for t in tokens]
    assert np.allclose(base, [sum(math.log10(count[w] + 1) for w in t) for t in tokens])


def test_kt_is_a_probability():
    assert sum(math.comb(9, k) * math.exp(context_tree.kt(np.array([9 - k]), np.array([k]))[0]) for k in range(10)) == pytest.approx(1, abs=1e-8)
    n0, n1 = np.array([0, 3, 5000, 10**9]), np.array([2, 4095, 4096, 10**12])
    want = [math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - 2 * math.lgamma(0.5) for a, b in zip(n0.tolist(), n1.tolist(), strict=True)]
    assert np.allclose(context_tree.kt(n0, n1), want, rtol=1e-9, atol=1e-3)


def _optimum(items, cap):
    from functools import lru_cache

    @lru_cache(None)
    def fewest(mask):
        if not mask:
            return 0, 0
        best = (99, 0)
        for i, x in enumerate(items):
            if mask >> i & 1:
                bins, room = fewest(mask ^ 1 << i)
                new = (bins, room - x) if room >= x else (bins + 1, cap - x)
                if (new[0], -new[1]) < (best[0], -best[1]):
                    best = new
        return best

    return fewest((1 << len(items)) - 1)[0]


def test_bin_completion_is_optimal_on_small_cases():
    rng = random.Random(3)
    for _ in range(150):
        cap = rng.choice([10, 20, 50])
        items = tuple(rng.randrange(1, cap + 1) for _ in range(rng.randrange(0, 10)))
        packed = bin_completion.pack(np.bincount(items, minlength=cap + 1) if items else np.zeros(cap + 1, int))
        assert sorted(x for b in packed for x in b) == sorted(items) and all(sum(b) <= cap for b in packed)
        assert len(packed) == _optimum(items, cap)


def test_bin_completion_beats_best_fit():
    """A case of 31 pieces in which best fit needs a bin more than the bound, and the search finds the optimum."""
    items = [29, 32, 41, 43, 47, 57, 57, 58, 60, 63, 64, 64, 67, 69, 71, 75, 78, 85, 86, 88, 96, 100, 109, 113, 116, 118, 119, 125, 136, 137, 138]
    counts = np.bincount(items, minlength=201)
    packed = bin_completion.pack(counts)
    assert sorted(x for b in packed for x in b) == items and all(sum(b) <= 200 for b in packed)
    assert len(packed) == bin_completion.least_bins(counts) == len(bin_completion.best_fit(counts)) - 1


def test_completions_are_all_undominated_fillings():
    from itertools import combinations

    rng = random.Random(12)
    for _ in range(60):
        items = [rng.randrange(1, 15) for _ in range(rng.randrange(1, 9))]
        room = rng.randrange(1, 31)
        got = list(bin_completion.completions(bin_completion._Stock(np.bincount(items, minlength=31)), room, room, [10**6]))
        every = {tuple(sorted(c, reverse=True)) for k in range(len(items) + 1) for c in combinations(items, k) if sum(c) <= room}

        def stands_in(f):
            """A piece outside f that can replace some of its pieces for the better."""
            rest = Counter(items) - Counter(f)
            return any(sum(part) <= x <= sum(part) + room - sum(f) and part != (x,) for x in rest for k in range(len(f) + 1) for part in combinations(f, k))

        assert len(got) == len(set(got)) and set(got) == {f for f in every if not stands_in(f)}
        assert [sum(f) for f in got] == sorted((sum(f) for f in got), reverse=True)


def test_long_blanks_are_tokenised():
    import public_tokenizers as tok
    from tokenizers import Tokenizer

    encode = bin_completion.encoder(str(tok.path("byte_bpe_50k.tiktoken")), str(tok.path("byte_bpe_50k.json")), tok.PATTERN)
    text = "a" + " " * 1_000_000 + "b"
    assert encode(text).tolist() == Tokenizer.from_file(str(tok.path("byte_bpe_50k.json"))).encode(text, add_special_tokens=False).ids


def test_bin_completion_on_many_pieces():
    sizes = np.minimum(2048, np.random.default_rng(0).lognormal(6.0, 0.9, 5000).astype(int) + 1)
    counts = np.bincount(sizes, minlength=2049)
    packed = bin_completion.pack(counts)
    assert Counter(x for b in packed for x in b) == Counter(sizes.tolist()) and max(map(sum, packed)) <= 2048
    assert bin_completion.least_bins(counts) <= len(packed) <= len(bin_completion.best_fit(counts))


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    df = documents(spark, ["plain text", None, "", "with <|endoftext|> inside", "word " * 3000, "ключ \U0001f600 é", "a" * 5000])
    rows = df.collect()
    got = bin_completion.pack_documents(df).collect()
    want = Counter()
    for r in rows:
        ids = np.array(tok.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4")
        for k, (s, n) in enumerate(bin_completion.cut(len(ids))):
            want[str(r.doc_id), k, s, n, zlib.crc32(ids[s : s + n].tobytes())] += 1
    assert Counter((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by_sequence = defaultdict(list)
    for r in got:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for own in by_sequence.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 2048
    assert bin_completion.cut(4096) == [(0, 2048), (2048, 2048)] and bin_completion.cut(4097) == [(0, 1), (1, 2048), (2049, 2048)]


def test_gam_learns_and_handles_odd_rows(spark):
    rng = random.Random(11)
    good = [prose(rng, rng.randrange(5, 150)) for _ in range(300)]
    bad = [" | ".join(prose(rng, rng.randrange(5, 150)).split()) for _ in range(300)]
    rows = [(k, t, "en", "s") for k, t in enumerate(good + bad)] + [(9000, None, None, None), (9001, "", None, None), (None, "text", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, bin string").repartition(3)
    labels = spark.createDataFrame([(k, int(k < 300), 0) for k in range(600)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = boosted_gam.quality(docs, labels).collect()
    assert len(got) == 603 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 600 and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in held) and len(held) > 100
    assert np.mean([r.predicted == int(r.doc_id < 300) for r in held]) > 0.95
    assert {r.score for r in boosted_gam.quality(docs, labels.limit(0)).collect()} == {0.5}
    assert boosted_gam.quality(docs.limit(0), labels).collect() == []


def test_gam_score_is_a_sum_of_table_entries():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(800, len(boosted_gam.FEATURES)))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (x[:, 2] > 1)).astype(float)
    model = boosted_gam.fit(x, y)
    b = model.bins(x[:5])
    f = [model.base + sum(t[b[i, j]] for j, t in enumerate(model.tables)) + sum(t[b[i, p], b[i, q]] for p, q, t in model.pairs) for i in range(5)]
    assert np.allclose(model.score(x[:5]), 1 / (1 + np.exp(-np.array(f))))
    assert any({p, q} == {0, 1} for p, q, _ in model.pairs) and ((model.score(x) > 0.5) == y).mean() > 0.85


def test_gam_splits_are_the_best_ones():
    rng = np.random.default_rng(3)
    gain = lambda g, h: g**2 / (h + 1)
    for _ in range(30):
        g, h, n = rng.normal(size=12), rng.random(12) * 9, rng.integers(1, 30, 12)
        step = boosted_gam._tree(g, h, n, leaves=2)
        cuts = [(gain(g[:c].sum(), h[:c].sum()) + gain(g[c:].sum(), h[c:].sum()), c) for c in range(1, 12) if min(n[:c].sum(), n[c:].sum()) >= boosted_gam.LEAST_LEAF]
        best, c = max(cuts)
        want = np.concatenate((np.full(c, g[:c].sum() / (h[:c].sum() + 1)), np.full(12 - c, g[c:].sum() / (h[c:].sum() + 1))))
        assert best <= gain(g.sum(), h.sum()) + 1e-9 or np.allclose(step, want)
        g, h, n = rng.normal(size=(5, 6)), rng.random((5, 6)) * 9, rng.integers(5, 30, (5, 6))
        found, value = boosted_gam._quadrants(g, h, n)
        every = []
        for i in range(1, 5):
            for j in range(1, 6):
                parts = [(slice(0, i), slice(0, j)), (slice(0, i), slice(j, None)), (slice(i, None), slice(0, j)), (slice(i, None), slice(j, None))]
                if min(n[p].sum() for p in parts) >= boosted_gam.LEAST_LEAF:
                    every.append((sum(gain(g[p].sum(), h[p].sum()) for p in parts) - gain(g.sum(), h.sum()), i, j, parts))
        best = max(every, key=lambda e: e[0])
        assert found == pytest.approx(best[0]) and all(np.allclose(value[p], g[p].sum() / (h[p].sum() + 1)) for p in best[3])


def test_gam_training_rows_are_bounded_by_the_sample(spark):
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(300)] + [(k, "other text here") for k in range(2, 40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(1, 40)], "doc_id long, quality int, toxic int")
    seen = []
    fit = boosted_gam.fit
    try:
        boosted_gam.fit = lambda x, y: seen.append(len(y)) or fit(x, y)
        boosted_gam.train(docs, labels, 10)
        boosted_gam.train(docs, labels)
    finally:
        boosted_gam.fit = fit
    assert seen == [10, sum(boosted_gam.crc(k, 4) != 2 for k in range(1, 40))]


def test_very_long_texts(spark):
    """A text of a megabyte among short ones, for the operators whose other tests hold none that long."""
    rng = random.Random(17)
    words = [prose(rng, 1) + str(k) for k in range(4000)]
    long_ = " ".join(rng.choice(words) for _ in range(120_000))
    df = spark.createDataFrame([(0, long_, "en", "a"), (1, "a short text", "en", "a"), (2, long_ + " end", "en", "b"), (3, None, None, None)], "doc_id long, text string, lang string, source string")
    assert len(long_) > 1_000_000
    size = {r.doc_id: r["size"] for r in entropy_mix.mix(df).collect()}
    assert size == {0: 120_000, 1: 3, 2: 120_001, 3: 0}
    words_of = {r.doc_id: r.n_words for r in robust_outliers.robust_outliers(df).collect()}
    assert words_of == {0: 120_000, 1: 3, 2: 120_001, 3: 0}
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in boosted_gam.quality(df, labels).collect())
    groups = {r.doc_id: r.component_id for r in simhash_ball.simhash_groups(df).collect()}
    assert groups[0] == groups[2] == 0
    stripped = {r.doc_id: r.text for r in bwt_dedup.strip_words(df).collect()}
    assert stripped[0] == "" and stripped[2].strip() == "end" and stripped[1] == "a short text"
    scored = {r.doc_id: r.n_tokens for r in context_tree.score(df).collect()}
    assert scored == {0: 120_001, 1: 4, 2: 120_002, 3: 1}
