"""Vectors, pages, conversations, and the pipeline."""

import random
import re

import numpy as np
import pytest

from strandmill.llm import host_consensus, permutation_index, quote_links
from strandmill.llm.host_consensus import Page

from .helpers import documents, prose

VECTORS = "vec_id long, embedding array<float>, label int, score string"


def _vectors(spark, n=900, hot=200, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 16)).astype(np.float32)
    x[:hot] = x[0]  # one very common vector
    odd = [(n, None), (n + 1, [0.0] * 16), (n + 2, [float("nan")] * 16), (n + 3, [None] * 16), (n + 4, [1.0] * 3), (n + 5, [float("inf")] + [1.0] * 15), (None, [1.0] * 16)]
    rows = [(k, v.tolist(), 0, "x") for k, v in enumerate(x)] + [(k, v, 0, "x") for k, v in odd]
    return x, spark.createDataFrame(rows, VECTORS).repartition(3)


def test_nearest_vectors(spark):
    x, df = _vectors(spark)
    got = {}
    for r in permutation_index.nearest(df).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert sorted(got) == list(range(0, 900, 20))
    hits = 0
    for q, own in got.items():
        s = (x.astype(float) * x[q].astype(float)).sum(1)
        best = [k for k in np.lexsort((np.arange(len(x)), -s)) if k != q][:20]
        assert sorted(own) == list(range(1, 21))
        assert all(own[k][1] == s[own[k][0]] for k in own) and [own[k] for k in sorted(own)] == sorted(own.values(), key=lambda v: (-v[1], v[0]))
        hits += len({own[k][0] for k in own} & set(best))
        if q < 200:
            assert [own[k][0] for k in sorted(own)] == best
    assert hits >= 0.9 * 20 * len(got)


def test_rows_of_a_query_do_not_grow_with_the_blocks(spark, monkeypatch):
    _, df = _vectors(spark)
    want = [tuple(r) for r in permutation_index.nearest(df, share=1.0).orderBy("query_id", "rank").collect()]
    made, search = spark.sparkContext.accumulator(0), permutation_index._search

    def counted(batches, k, share):
        for b in search(batches, k, share):
            made.add(b.num_rows)
            yield b

    monkeypatch.setattr(permutation_index, "_search", counted)
    monkeypatch.setattr(permutation_index, "BLOCK", 30)
    monkeypatch.setattr(permutation_index, "QUERY_BLOCK", 12)
    got = [tuple(r) for r in permutation_index.nearest(df, share=1.0).orderBy("query_id", "rank").collect()]
    assert got == want and len(got) == 45 * 20
    assert made.value <= 45 * 20 * 8  # 45 queries, 30 blocks


def test_few_and_no_vectors(spark):
    few = spark.createDataFrame([(0, [1.0, 2.0], 0, "x"), (1, [2.0, 1.0], 0, "x"), (0, [1.0, 2.0], 0, "x")], VECTORS)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in permutation_index.nearest(few).collect()) == [(0, 1, 0, 5.0), (0, 1, 0, 5.0), (0, 2, 1, 4.0), (0, 2, 1, 4.0)]
    assert permutation_index.nearest(few.limit(0)).collect() == []


def test_footrule_candidates_match_full_scan():
    rng = np.random.default_rng(2)
    x, pivots = rng.normal(size=(200, 8)), rng.normal(size=(32, 8))
    order = permutation_index.nearest_pivots(x, pivots, np.zeros(200), np.zeros(32), 8)
    post = np.argsort(order.ravel(), kind="stable")
    at = np.searchsorted(order.ravel()[post], np.arange(33))
    found = permutation_index.candidates(order[3], (post // 8).astype(np.int32), (post % 8).astype(np.int16), at, 200, 20)
    rank = lambda o, p: o.tolist().index(p) if p in o else 16
    footrule = [sum(abs(rank(order[3], p) - rank(o, p)) for p in order[3]) for o in order]
    assert found.tolist() == sorted(sorted(range(200), key=lambda k: (footrule[k], k))[:20])


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p><p>no";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/">menu</a></li></ul></nav><div class="cookie-notice">Accept &amp; go</div>
<div class="content-12 wrapper"><aside>side</aside><article class="post p7"><header><h2>Head &lt;line&gt;</h2></header><p>First   part<br>goes&nbsp;on <b>here <a href=x>link</a>
<p>Second &copy; 2026 &#228;<ul><li>one<li>two</ul><table><tr><td>a<td>b</table><div class="ad box">buy</div><form><p>mail</p></form><footer>by me</footer></article>
<div id="comments"><p>A very long reader comment that should go away, however long it may be, as readers write a lot</p></div></div><footer>&copy; site</footer></body></html>"""


def test_page_text():
    page = Page(PAGE)
    want = "Head <line>\n\nFirst part goes on here link\n\nSecond © 2026 ä\n\none\n\ntwo\n\na\n\nb"
    assert page.extract([]) == want
    assert page.name[page.own_best()] == "article.p#.post"
    assert page.extract([1, page.path[page.own_best()]]) == want


def test_whole_article_stays(spark):
    long_ = "Body text of the article, long enough to hold most of it. " * 9
    parts = ["Title", "The lead.", long_.strip(), "The end."]
    pages = [
        f'<body><article><h1>Title</h1><p>The lead.</p><div class="entry-content"><p>{long_}</p></div><p>The end.</p></article><div>other</div></body>',
        f'<body><div class="post"><h1>Title</h1><p>The lead.</p><div class="entry-content"><p>{long_}</p></div><p>The end.</p></div></body>',
        f"<body><main><div><h1>Title</h1></div><p>The lead.</p><blockquote>{long_}</blockquote><div>The end.</div></main></body>",
        f'<body><div class="a"><div class="top"><h1>Title</h1><p>The lead.</p></div><div class="entry"><p>{long_}</p></div><div class="entry"><p>The end.</p></div></div></body>',
    ]
    for k, page in enumerate(pages):
        assert Page(page).extract([]) == "\n\n".join(parts)
        rows = [(i, f"http://h{k}.example/{i}", page) for i in range(5)]
        got = host_consensus.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
        assert [r.text for r in got] == ["\n\n".join(parts)] * 5


@pytest.mark.parametrize("html", ["", "<", "plain text & more", "</p></div>", "<p", "<p>unclosed <b>bold", "<div " + "x" * 5000, "<!-- open", "<script>never closed", "<p>a" * 3000, "<div>" * 3000 + "deep", "\x00<p>퟿</p>"])
def test_broken_pages_never_fail(html):
    assert isinstance(Page(html).extract([]), str)


@pytest.mark.parametrize(
    "html", ["<p " + '"a" ' * 50_000, "<p " * 350_000, "</x>" * 200_000, "<p a=\"'" * 100_000, "<b>" * 20_000 + "<p>x</p>" * 20_000, "<" * 100_000, "<!--" * 100_000, "<svg><b>" * 20_000 + "<p>x", "<title>" * 100_000, "<select>" * 20_000]
)
def test_scanner_takes_linear_time(html):
    import time

    began = time.process_time()
    Page(html).extract([])
    assert time.process_time() - began < 10


def test_deep_pages_take_linear_memory():
    import tracemalloc

    tracemalloc.start()
    page = Page("<div>x" * 50_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(page.blocks) == 50_000 and peak < 150_000_000


def test_only_raw_elements_hide_what_follows():
    cases = {
        "<p>a</p><svg width='1'/>b<p>c</p>": "a\n\nb\n\nc",
        "<article><p>one</p><select><option>x<p>two</p></article>": "one\n\ntwo",
        "<article><p>one <math><mi>x</mi></math> two</p><svg><title>drawn</title><text>y</text></svg></article>": "one x two",
        "<article><p>a<video>no video</video> b</p><noscript>no script</noscript><video src=x><p>more</p></article>": "a b\n\nmore",
        "<article><p>kept</p><p class=\"x": "kept",
        "<article><p>a &lt; b < c > d</p></article>": "a < b < c > d",
        "<p>x<script>if (a < b) '</p>'</script>y</p>": "x y",
    }
    for html, want in cases.items():
        assert Page(html).extract([]) == want, html


def test_a_word_within_a_name_is_no_verdict():
    body = '<section class="search-results"><p>kept one</p></section><div class="related-work">kept two</div><div class="promotion-history">kept three</div><div class="has-sidebar"><p>kept four</p></div>'
    gone = '<p class="notice">gone</p><div class="related-posts">gone</div><div id="siteFooter">gone</div><div class="post-comments">gone</div><div class="search-paths"><a href=x>one</a> <a href=y>two</a></div>'
    assert Page(f"<article>{body}{gone}</article>").extract([]) == "kept one\n\nkept two\n\nkept three\n\nkept four"


def test_many_hosts_meet_by_shuffle(spark, monkeypatch):
    from strandmill.llm import common

    monkeypatch.setattr(common, "BROADCAST_ROWS", 2)
    rows = [(k, f"http://h{k % 7}.example/{k}", f'<div class="c{k}"><p>Text {k} of a page.</p></div><div class="comments">no</div>', "x") for k in range(40)]
    got = {r.page_id: r.text for r in host_consensus.extract(spark.createDataFrame(rows, "page_id long, url string, html string, _salt string").repartition(3)).collect()}
    assert got == {k: f"Text {k} of a page." for k in range(40)}


def test_hosts_agree(spark):
    body = "<p>Text of the article, long enough to matter here.</p>" * 3
    rows = [(k, f"https://A.example/{k}", f'<body><div class="main{k}">{body}</div><div class="zone">{"<p>chatter of others</p>" * 2}</div></body>', "x") for k in range(9)]
    rows += [(50, "http://a.example/short", '<body><div class="main1"><p>Short.</p></div><div class="zone"><p>much more chatter than text is on this page</p></div></body>', "x"), (51, None, None, "x"), (None, "http://b.example", "<p>alone</p>", "x"), (52, "http://a.example/x", "<body><p>other layout</p></body>", "x")]
    got = {r.page_id: r for r in host_consensus.extract(spark.createDataFrame(rows + rows[:1], "page_id long, url string, html string, text string")).collect()}
    assert got[50].text == "Short." and got[51].text == "" and got[51].n_chars == 0 and got[None].text == "alone" and got[52].text == "other layout"
    assert all(got[k].text == "\n\n".join(["Text of the article, long enough to matter here."] * 3) for k in range(9))
    assert host_consensus.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


MESSAGES = "conv_id long, turn long, role string, text string, depth string"


def test_quotes(spark):
    rows = [
        (1, 0, "user", "Hello there, how are you doing today my friend?\nSecond line that is long enough too."),
        (1, 1, "assistant", "> Hello there, how are you doing today my friend?\n> Second line that is long enough too.\nI am fine."),
        (1, 2, "user", ">> Hello there, how are you doing today my friend?\n> I am fine.\nGood to hear that."),
        (1, 3, "assistant", ">  second LINE that is long enough too.\nanswering the first"),
        (2, 0, "user", "> Good to hear that.\nOther conversation"), (2, 1, "user", "no quote"), (2, 2, "user", None),
        (None, None, None, "> unknown words quoted here in nulls\nx"), (3, 0, "user", "> never said by anyone at all ever\n> > deeper\nmine"),
    ]
    got = [tuple(r) for r in quote_links.conversations(spark.createDataFrame([(*r, "x") for r in rows], MESSAGES).repartition(3)).collect()]
    want = [
        (None, None, None, "x", 1, 0, None, None, None, None, 0, 1),
        (1, 0, "user", rows[0][3], 0, 0, None, None, 1, 0, 0, 1),
        (1, 1, "assistant", "I am fine.", 1, 1, 1, 0, 1, 0, 1, 2),
        (1, 3, "assistant", "answering the first", 1, 1, 1, 0, 1, 0, 1, 3),
        (1, 2, "user", "Good to hear that.", 2, 2, 1, 1, 1, 0, 2, 4),
        (2, 0, "user", "Other conversation", 1, 1, 1, 2, 1, 0, 3, 5),
        (2, 1, "user", "no quote", 0, 0, 2, 0, 1, 0, 4, 6),
        (2, 2, "user", "", 0, 0, 2, 0, 1, 0, 4, 7),
        (3, 0, "user", "mine", 2, 0, None, None, 3, 0, 0, 1),
    ]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert quote_links.conversations(spark.createDataFrame([], MESSAGES)).collect() == []


def _threads(rows):
    """The same rules, message by message. rows: (conv_id, turn, text), all different."""
    clean = lambda t: re.sub(r"[\s>]+", " ", t.lower()).strip(" ")
    level = lambda x: len(re.match(r"(?:[ \t]*>)*", x)[0].replace(" ", "").replace("\t", ""))

    def units(t):
        parts = [(3, t), *[(2, x) for x in re.split(r"\n[ \t]*\n", t)], *[(1, x) for x in t.split("\n")]]
        return [(kind, clean(x)) for kind, x in parts if clean(x)]

    own, passages = {}, {}
    for c, k, t in rows:
        lines = [(level(x), x) for x in (t or "").split("\n")]
        own[c, k] = "\n".join(x for n, x in lines if not n).strip(" ")
        runs = []
        for n, x in lines:
            if runs and runs[-1][0] == n:
                runs[-1][1].append(x)
            else:
                runs.append((n, [x]))
        passages[c, k] = [(n, "\n".join(re.sub(r"^(?:[ \t]*>)+[ ]?", "", x) for x in xs)) for n, xs in runs if n]
    first = {}
    for m in sorted(own):
        for _, u in units(own[m]):
            first.setdefault(u, {}).setdefault(m[0], m)
    up, n_linked = {}, {}
    for m in sorted(own):
        best = []
        for p, (n, text) in enumerate(passages[m]):
            found = []
            for kind, u in units(text):
                at = first.get(u, {})
                other = min((x for c, x in at.items() if c != m[0]), default=None)
                if m[0] in at and at[m[0]] < m:
                    found.append((n, -kind, -len(u), p, at[m[0]]))
                elif (len(u) >= quote_links.LEAST or kind == 3) and other:
                    found.append((n, -kind, -len(u), p, other))
            best += [min(found)] if found else []
        n_linked[m] = len(best)
        head = min(x for x in own if x[0] == m[0])
        up[m] = min(best)[-1] if best else head if head != m else None
    for m in sorted(up):
        path, at = [], m
        while at is not None and at not in path:
            path.append(at)
            at = up[at]
        if at is not None:
            up[min(path[path.index(at) :])] = None
    out = {}
    for m in up:
        depth, at = 0, m
        while up[at] is not None:
            depth, at = depth + 1, up[at]
        out[m] = (own[m], len(passages[m]), n_linked[m], up[m], at, depth)
    place = {}
    for root in {o[4] for o in out.values()}:
        for k, m in enumerate(sorted((m for m in out if out[m][4] == root), key=lambda m: (out[m][5], m)), 1):
            place[m] = k
    return {m: (*o, place[m]) for m, o in out.items()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_generated_quotes_match_plain_rules(spark, seed):
    rng = random.Random(seed)
    said: list[str] = ["Yes.", "no way", "> stray mark inside"]
    rows = []
    for k in range(150):
        parts = []
        for _ in range(rng.randrange(0, 3)):
            quoted = rng.choice(said).split("\n")
            mark = rng.choice(["> ", ">", ">> ", "> > ", " > "])
            parts += [mark + (x.upper() if rng.random() < 0.2 else x) for x in quoted[: rng.randrange(1, 4)]]
        for _ in range(rng.randrange(1, 4)):
            parts.append(rng.choice(["Yes.", "ok", "", prose(rng, rng.randrange(1, 12)), "a remark that many messages make again", rng.choice(said[-9:])]))
        text = "\n".join(parts)
        said.append(text)
        rows.append((rng.choice([0, 1, 2, 3, 40, 41]), k, text))
    rows = [(c if rng.random() < 0.8 else 50 - c, k, t) for c, k, t in rows]
    df = spark.createDataFrame([(c, k, "user", t, "x") for c, k, t in rows], MESSAGES).repartition(4)
    got = {(r.conv_id, r.turn): (r.text, r.n_quotes, r.n_linked, None if r.parent_conv is None else (r.parent_conv, r.parent_turn), (r.thread_conv, r.thread_turn), r.depth, r.position) for r in quote_links.conversations(df).collect()}
    want = _threads(rows)
    assert got == want and sum(w[2] for w in want.values()) > 30


def test_circles_of_answers_are_opened(spark):
    a, b, c = ("a first remark that is long enough to be found", "another remark that is long enough to be found", "a third remark that is long enough to be found")
    rows = [(1, 0, f"> {b}\n{a}"), (2, 0, f"> {c}\n{b}"), (3, 0, f"> {a}\n{c}"), (3, 1, "hangs on it"), (9, 0, f"> {c}\nfrom outside")]
    df = spark.createDataFrame([(x, k, "user", t, "x") for x, k, t in rows], MESSAGES)
    got = {(r.conv_id, r.turn): (r.parent_conv, r.thread_conv, r.depth) for r in quote_links.conversations(df).collect()}
    assert got == {(1, 0): (None, 1, 0), (2, 0): (3, 1, 2), (3, 0): (1, 1, 1), (3, 1): (3, 1, 2), (9, 0): (3, 1, 2)}


def test_long_reply_chains(spark):
    rows = [(k // 3, k % 3, "user", (f"> this is message number {k - 1} of the chain\n" if k else "") + f"this is message number {k} of the chain", "x") for k in range(40)]
    got = {(r.conv_id, r.turn): r for r in quote_links.conversations(spark.createDataFrame(rows, MESSAGES).repartition(4)).collect()}
    for k in range(40):
        r = got[k // 3, k % 3]
        assert (r.thread_conv, r.thread_turn, r.depth, r.position) == (0, 0, k, k + 1)


def test_pipeline_stages(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = documents(spark)
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, "")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    assert docs.count() > 0
