"""Characters counted and put in Arrow batches, against plain Python, and the plans that rest on them."""

from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandmill.functions import letters
from strandmill.operators import composition
from strandmill.plans import cubes
from strandmill.reads import canonical

TEXTS = ["ACGTN", "", "G" * 30, "Aé😀C", None, "CGCG" * 300, "日本", "A"]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _reads(spark):
    return canonical(spark.createDataFrame([(k + 1, "@x", s, "" if k % 2 else "I5" * k, False) for k, s in enumerate(TEXTS)], "ord long, id string, sequence string, quality string, is_filtered boolean"))


@pytest.mark.parametrize("piece", [1, 40, 1 << 22])
def test_read_counts(monkeypatch, piece):
    monkeypatch.setattr(letters, "PIECE", piece)
    qualities = ["" if k % 2 else "I5" * k for k in range(len(TEXTS))]
    batch = pa.RecordBatch.from_arrays([pa.array(TEXTS), pa.array(qualities)], ["sequence", "quality"])
    got = Counter()
    for b in letters.count_reads(iter([batch, batch.slice(2, 4)])):
        for r in b.to_pylist():
            got[r["len"], r["tlen"], r["gc"], r["avgq"]] += r["n"]
    want = Counter()
    for s, q in [*zip(TEXTS, qualities, strict=True), *zip(TEXTS[2:6], qualities[2:6], strict=True)]:
        n = None if s is None else len(s)
        t = n if n is None or n <= 100 else n // 100 * 100 if n <= 1000 else n // 1000 * 1000
        want[n, t, None if s is None else sum(c in "GC" for c in s[:t]), sum(map(ord, q)) // len(q) if q else None] += 1
    assert got == want


def test_letters_are_put_by_a_table(spark):
    table = bytes(c + 1 if c < 127 else ord("N") for c in range(256))
    df = spark.createDataFrame([(k, s) for k, s in enumerate(TEXTS)], "k int, s string").select("k", letters.mapped(F.col("s"), table).alias("s"))
    assert [r.s for r in df.orderBy("k").collect()] == [s if s is None else "".join(chr(ord(c) + 1) if ord(c) < 127 else "N" for c in s) for s in TEXTS]


def test_gc_distribution_reads_the_reads_once(spark, tmp_path):
    spark.createDataFrame([(k, s) for k, s in enumerate(TEXTS)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    from strandmill.plans import catalog

    plan = _plan(catalog.QUERIES["gc_distribution_long"](spark, str(tmp_path)))
    assert plan.count("parquet") == 1 and "regexp_replace" not in plan
    n = sum(r.n for r in composition.gc_distribution(cubes.read_cube(_reads(spark))).collect())
    assert n > 0


@pytest.mark.parametrize("piece, cells", [(1, 1 << 22), (40, 50), (1 << 22, 1), (1 << 22, 1 << 22)])
def test_place_counts(monkeypatch, piece, cells):
    monkeypatch.setattr(letters, "PIECE", piece)
    monkeypatch.setattr(letters, "CELLS", cells)
    batch = pa.RecordBatch.from_arrays([pa.array(TEXTS)], ["sequence"])
    got = Counter()
    for b in letters.count_places(iter([batch, batch.slice(3, 4), batch.slice(0, 0)])):
        for r in b.to_pylist():
            got[r["pos"], r["c"]] += r["n"]
    assert got == Counter((k, c) for s in [*TEXTS, *TEXTS[3:7]] if s for k, c in enumerate(s, 1))


def test_places_are_counted_without_a_row_a_character(spark):
    reads = _reads(spark)
    for cube, column in ((cubes.base_cube(reads), "sequence"), (cubes.quality_cube(reads), "quality")):
        assert "Generate" not in _plan(cube)
        assert sum(r.n for r in cube.collect()) == sum(len(r[0] or "") for r in reads.select(column).collect())
    lowest = _plan(composition.basic_stats(reads))
    assert "lambda" not in lowest


def test_the_quality_of_reads_outside_the_tile_sample_is_not_made(spark):
    from .conftest import SMALL

    from strandmill.reads import fixture_reads, passed

    plan = _plan(cubes.tile_cube(passed(fixture_reads(spark, SMALL, "short")), 4)).splitlines()
    made = [k for k, line in enumerate(plan) if "EvalPython" in line]
    # The place is asked below the first step in Python, above the scan.
    assert any("% 10" in line for line in plan[made[-1] + 1 :])
