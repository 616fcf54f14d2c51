import gzip
import json
import os
import random
import zipfile
from datetime import date

import pytest

from strandmill.config import DEFAULT_LIMITS, Limits, QcConfig
from strandmill.operators import duplication, motifs
from strandmill.plans import cubes, engine
from strandmill.reads import canonical
from strandmill.report.bundle import long_date, write
from strandmill.report.svg import gradient, y_interval
from strandmill.report.text import data_text, summary_text
from strandmill.sources.files import read_sequences
from strandmill.streaming.windows import windowed_quality


def run(spark, reads, known=None, **options):
    df = spark.createDataFrame([(k + 1, i, s, q, False) for k, (i, s, q) in enumerate(reads)], "ord long, id string, sequence string, quality string, is_filtered boolean")
    return engine.analyze(canonical(df), QcConfig(**options), "x.fastq", known)


def test_five_equal_reads(spark):
    r = run(spark, [(f"@READ{k}", "ACGT" * 4, "I" * 16) for k in range(5)])
    assert r.status() == {
        "Basic Statistics": "pass", "Per base sequence quality": "pass", "Per sequence quality scores": "fail", "Per base sequence content": "fail", "Per sequence GC content": "warn",
        "Per base N content": "pass", "Sequence Length Distribution": "pass", "Sequence Duplication Levels": "fail", "Overrepresented sequences": "fail", "Adapter Content": "pass",
    }
    text = data_text(r)
    for line in ("Encoding\tIllumina 1.5", "1\t9.0\tNaN\tNaN\tNaN\tNaN\tNaN", "9\t5.0", "16\t5.0", "#Total Deduplicated Percentage\t20.0", "ACGTACGTACGTACGT\t5\t100.0\tNo Hit"):
        assert line in text
    gc = r.table("Per sequence GC content").data["bins"]
    assert gc[47:54] == [2.5, 5, 5, 5, 5, 5, 2.5] and sum(gc) == 30
    assert len(r.table("Adapter Content").rows) == 5
    assert summary_text(r).splitlines()[0] == "PASS\tBasic Statistics\tx.fastq"
    assert r.table("Per tile sequence quality").hidden


def test_one_read_of_one_base(spark):
    r = run(spark, [("@R", "A" * 16, "I" * 16)], min_length=20)
    assert r.table("Per sequence GC content").data["bins"][:4] == [1, 1, 1, 0.5]
    adapter = r.table("Adapter Content")
    assert adapter.status == "fail" and len(adapter.rows) == 20 and adapter.rows[0][5] == "100.0" and adapter.rows[19][5] == "0.0"
    assert r.table("Sequence Duplication Levels").status == "pass"


def test_high_quality_reads_by_format(spark):
    reads = [(f"@R{k}", ("ACGT" * 9)[:34], "I" * 34) for k in range(150)]
    assert run(spark, reads).table("Per base sequence quality").rows[0][1] == "9.0"
    assert run(spark, reads, known=33).table("Per base sequence quality").rows[0][1:3] == ["40.0", "40.0"]


def test_no_reads(spark):
    r = run(spark, [])
    assert r.table("Per base sequence quality").hidden and r.table("Per sequence quality scores").hidden
    assert r.table("Adapter Content").status == "warn" and r.table("Adapter Content").rows[0][1] == "NaN"
    assert r.table("Sequence Duplication Levels").lead[0][1] == "100.0"


def test_tiles_kmers_and_ignored_modules(spark):
    rng = random.Random(3)
    reads = [(f"@M:1:F:1:{1101 + k % 2}:{k}:1", "ACGTT" + "".join(rng.choice("ACGT") for _ in range(30)), ("I" if k % 2 else "5") * 35) for k in range(300)]
    limits = Limits(DEFAULT_LIMITS + "kmer ignore 0\nsequence ignore 1\noverrepresented ignore 1\n")
    r = run(spark, reads, limits=limits, known=33, kmer_size=5)
    tile = r.table("Per tile sequence quality")
    assert tile.status == "warn" and tile.rows[0] == ["1101", "1", "-10.0"]
    assert not any(m.key in ("sequence", "overrepresented") for m in r.modules)
    assert all(row[1] == "0.0" for row in r.table("Sequence Duplication Levels").rows)
    assert r.table("Kmer Content").header == [] or r.table("Kmer Content").rows


def test_freeze_keeps_what_came_first(spark):
    order = ["a", "b", "a", "c", "d", "c", "a", "d", "e"]
    df = canonical(spark.createDataFrame([(k + 1, "@x", s, "", False) for k, s in enumerate(order)], "ord long, id string, sequence string, quality string, is_filtered boolean").repartition(3))
    cube = cubes.duplicate_cube(df)
    kept = duplication.admitted(cube, 3)
    assert {(r.prefix, r.n) for r in kept.collect()} == {("A", 3), ("B", 1), ("C", 2)}
    assert duplication.count_at_limit(kept, 3).first()[0] == 4
    rows = {r.level: r for r in duplication.duplication_levels(cube, len(order), 3).collect()}

    def loop(level, seen, at, total):
        miss = 1.0
        for i in range(at):
            miss *= max(total - i - level, 0) / (total - i)
        return seen / (1 - miss)

    exact = {n: loop(n, 1, 4, 9) for n in (1, 2, 3)}
    everything = sum(n * u for n, u in exact.items())
    assert rows["3"].percent == pytest.approx(300 * exact[3] / everything) and rows["1"].deduplicated == pytest.approx(100 * sum(exact.values()) / everything)


def test_adapters_of_mixed_length_follow_a_sequential_model(spark):
    rng = random.Random(8)
    adapters = [("x", "AC"), ("y", "GTA")]
    reads = ["".join(rng.choice("ACGT") for _ in range(rng.randrange(1, 14))) for _ in range(60)]
    longest, want = 0, {}
    for s in reads:
        if len(s) > max(longest, 3):
            longest = len(s)
        for k, (_, a) in enumerate(adapters):
            if 0 <= s.find(a) <= max(longest - 3, 0):
                want[k, s.find(a)] = want.get((k, s.find(a)), 0) + 1
    df = canonical(spark.createDataFrame([(k + 1, "@x", s, "", False) for k, s in enumerate(reads)], "ord long, id string, sequence string, quality string, is_filtered boolean").repartition(4))
    assert {(r.adapter, r.idx): r.n for r in motifs.adapter_hits(df, adapters).collect()} == want


def test_files_and_bundle(spark, tmp_path):
    for k in (1, 2):
        with gzip.open(tmp_path / f"s_00{k}.fastq.gz", "wt") as f:
            for i in range(3 * k):
                f.write(f"@{k}.{i} 1:{'Y' if i == 0 else 'N'}:1\nACGTACGTACGTACGTACGT\n+\nIIIIIIIIIIIIIIIIIII5\n")
    cfg = QcConfig(casava=True)
    reads = read_sequences(spark, [str(tmp_path / "s_001.fastq.gz"), str(tmp_path / "s_002.fastq.gz")], cfg, "s.fastq.gz")
    rows = reads.orderBy("ord").collect()
    assert [r.ord for r in rows] == list(range(1, 10)) and [r.ord_pf for r in rows] == [None, 1, 2, None, 3, 4, 5, 6, 7]
    result = engine.analyze(reads, cfg, "s.fastq.gz")
    assert dict(result.table("Basic Statistics").rows)["Sequences flagged as poor quality"] == "2"
    for template in ("classic", "modern"):
        html, archive = write(result, str(tmp_path / "s.fastq.gz"), template=template, extract=True, day=date(2026, 3, 7))
    assert os.path.basename(html) == "s_qc.html" and "Sat 7 Mar 2026" in open(html).read()
    names = zipfile.ZipFile(archive).namelist()
    assert names[0] == "s_qc/" and {"s_qc/data.txt", "s_qc/summary.txt", "s_qc/report.fo", "s_qc/Images/per_base_quality.svg"} <= set(names)
    assert os.path.exists(tmp_path / "s_qc" / "data.txt") and long_date(date(2026, 3, 17)) == "Tue 17 Mar 2026"
    (tmp_path / "bad.fastq").write_text("@a\nAC\n")
    with pytest.raises(Exception, match="cut short"):
        read_sequences(spark, [str(tmp_path / "bad.fastq")]).count()


def test_chart_helpers():
    assert [y_interval(x) for x in (10, 100, 35, 7)] == [1, 10, 5, 1] and gradient(0) == "#0000ff" and gradient(1) == "#ff0000"


def test_stream_and_batch_agree(spark, tmp_path):
    df = spark.sql("select timestamp '2026-01-01 00:00:00' + make_interval(0,0,0,0,0,cast(id*7 as int)) as ts, 'ACGT' as sequence, 'II5I' as quality from range(50)")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = windowed_quality(stream).writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    key = lambda rows: sorted(json.dumps(r.asDict(), default=str) for r in rows)
    assert key(spark.table("windows").collect()) == key(windowed_quality(df).collect())


def _values(df):
    return sorted(tuple(r) for r in df.select("ord", "ord_pf", "ord_q", "id", "sequence", "quality", "is_filtered", "colorspace").collect())


def test_plain_fastq_is_read_in_parts(spark, tmp_path):
    import random

    rng = random.Random(3)
    text = ""
    for k in range(300):
        n = rng.randrange(0, 40)
        quality = "".join(rng.choice("@+I#5") for _ in range(n))
        text += "\n" * (k % 17 == 0) + f"@r{k} 1:{'Y' if k % 5 == 0 else 'N'}:0\n" + "".join(rng.choice("ACGTN") for _ in range(n)) + f"\n+\n{quality}\n"
    path = tmp_path / "a.fastq"
    path.write_text(text)
    cfg = QcConfig(casava=True)
    want = _values(read_sequences(spark, [str(path)], cfg))
    assert len(want) == 300
    for size in (37, 200, 5000):
        got = read_sequences(spark, [str(path)], cfg, split=size)
        assert size > 1000 or got.rdd.getNumPartitions() > 20
        assert _values(got) == want
    colors = tmp_path / "c.csfastq"
    colors.write_text("".join(f"@r{k}\nT0123{k % 4}\n+\nIIIII\n" for k in range(50)))
    assert _values(read_sequences(spark, [str(colors)], split=100)) == _values(read_sequences(spark, [str(colors)]))


def test_sam_is_read_in_parts(spark, tmp_path):
    import io

    from strandmill.sources import records

    lines = ["@HD\tx"]
    for k in range(400):
        lines.append(f"r{k}\t{(4 if k % 7 == 0 else 0) + (16 if k % 3 == 0 else 0) + (512 if k % 5 == 0 else 0)}\tc\t1\t0\t2S6M1S\t*\t0\t0\t{'ACGTNACGT' if k % 4 else '*'}\t{'*' if k % 9 == 0 else 'IIHHGG@@5'}" + "\r" * (k % 2))
    paths = []
    for name, part in (("b.sam", lines[:250]), ("a.sam", lines[250:])):
        (tmp_path / name).write_text("\n".join(part) + "\n\n")
        paths.append(str(tmp_path / name))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        for fmt in ("sam", "sam_mapped"):
            want = [r for p in paths for r in records.sam(open(p, "rb"), p, fmt == "sam_mapped")]
            df = read_sequences(spark, paths, QcConfig(format=fmt))
            got = df.orderBy("ord").collect()
            assert df.rdd.getNumPartitions() > 3
            assert [(r.id, r.sequence, r.quality, r.is_filtered, r.colorspace) for r in got] == want and [r.ord for r in got] == list(range(1, len(want) + 1))
            assert [r.ord_pf for r in got if not r.is_filtered] == list(range(1, sum(not w[3] for w in want) + 1))
            assert [r.ord_q for r in got if r.ord_q] == list(range(1, sum(not w[3] and bool(w[2]) for w in want) + 1))
        (tmp_path / "bad.sam").write_text("r1\tx\tc\n")
        with pytest.raises(Exception, match="no SAM record"):
            read_sequences(spark, [str(tmp_path / "bad.sam")]).count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_lines_and_boxes_are_joined():
    from strandmill.report.svg import minify

    line = lambda a, b, extra="": f'<line x1="{a}" y1="{a}" x2="{b}" y2="{b}" stroke="red"{extra}/>'
    assert minify("\n".join(line(k, k + 1) for k in range(4))) == '<polyline points="0,0 1,1 2,2 3,3 4,4" fill="none" stroke="red"/>'
    assert minify(line(0, 1) + line(1, 2)) == line(0, 1) + line(1, 2) and minify(line(0, 1) + line(5, 6) + line(6, 7)).count("<line") == 3
    assert minify(line(0, 1) + line(1, 2) + line(2, 3, ' id="x"')).count("<line") == 3
    box = lambda x, stroke="none": f'<rect x="{x}" y="5" width="2.5" height="3" fill="#fff" stroke="{stroke}"/>'
    assert minify(box(0) + box(2.5) + box(5)) == '<rect x="0" y="5" width="7.5" height="3" fill="#fff" stroke="none"/>'
    assert minify(box(0) + box(9)).count("<rect") == 2 and minify(box(0, "red") + box(2.5, "red")).count("<rect") == 2


def test_hooks_of_further_modules(spark, tmp_path):
    def build(reads, cfg):
        n = reads.count()
        chart = lambda: ("own_chart", "<svg><!-- c --></svg>")
        return engine.Module("Own", "own", "warn", ["n"], [[str(n)]], chart=chart, text=lambda: f"counted\t{n}", html=lambda: f"<p>own card {n}</p>")

    engine.register_module(build)
    engine.register_module(lambda reads, cfg: engine.Module("All", "all", "pass", ["n"], [[str(reads.count())]]), filtered_too=True)
    try:
        df = spark.createDataFrame([(1, "a", "ACGT", "IIII", False), (2, "b", "ACGT", "IIII", True)], "ord long, id string, sequence string, quality string, is_filtered boolean")
        result = engine.analyze(canonical(df), QcConfig(), "x.fastq")
    finally:
        engine.CUSTOM.clear()
    assert result.table("Own").rows == [["1"]] and result.table("All").rows == [["2"]]
    assert ">>Own\twarn\ncounted\t1\n>>END_MODULE" in data_text(result)
    html_path, zip_path = write(result, str(tmp_path / "x.fastq"))
    page = open(html_path).read()
    assert "own card 1" in page and "About this module" in page
    assert any(x.endswith("Images/own_chart.svg") for x in zipfile.ZipFile(zip_path).namelist())
