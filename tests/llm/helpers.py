"""Small tables with the awkward cases, and plain versions of shared rules."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: After the columns of documents, some whose names operators use themselves, with values and types of their own.
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, count string, _key string, _k1 string, _copy int, _size string, _salt date, key array<int>, `a.b` double, component_id string, _first int"
OWN = (0, 7, "x", "k", "k1", 5, "s", None, [1, 2], 0.5, "c", 9)
SYLLABLES = "the and ing er on re ti en at th st nd".split()


def prose(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def texts(rng):
    """Plain, copied, nearly copied, junk, blank, missing and very long texts."""
    plain = [prose(rng, rng.randrange(5, 120)) for _ in range(40)]
    near = []
    for t in plain[:8]:
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        near.append(" ".join(w))
    lines = "a line that comes again and again\n" * 30
    passage = prose(rng, 90)
    return [*plain, *plain[:6], *near, lines, "x### y$$$ z%%% " * 20, None, "", " \t\n", "one", "Ünï cödé", prose(rng, 3000), passage + " and more", "before " + passage, "ab" * 500]


def documents(spark, rows=None, seed=1):
    """rows: texts. Extra columns clash with names that operators use; one row is repeated; ids and sources may be null."""
    rng = random.Random(seed)
    rows = texts(rng) if rows is None else rows
    data = [(k, t, rng.choice(["en", "fr", None]), rng.choice(["a", "a", "b", None]), *OWN) for k, t in enumerate(rows)]
    if rows:
        data += [data[0], (None, "no id here at all", None, None, *OWN)]
    return spark.createDataFrame(data, DOCS).repartition(4) if data else spark.createDataFrame([], DOCS)


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
