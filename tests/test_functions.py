import bz2
import gzip
import io
import math
import os
import random
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandmill.config import Limits, QcConfig, read_pairs
from strandmill.functions import stats
from strandmill.functions.contaminants import best_hit, hit_text
from strandmill.operators import composition, verdicts
from strandmill.plans.groups import base_groups, label, linear_width
from strandmill.sources import records
from strandmill.sources.files import casava_name, expand, file_kind, grouped, nanopore_name, spooled


@pytest.mark.parametrize("flags", [{}, {"expgroup": True}, {"nogroup": True}])
@pytest.mark.parametrize("length", [0, 1, 9, 10, 75, 76, 100, 150, 250, 300, 1001, 2001])
def test_groups_cover_every_position_once(length, flags):
    assert [p for lo, hi in base_groups(length, **flags) for p in range(lo, hi + 1)] == list(range(length))


def test_group_labels_and_widths():
    groups = base_groups(100)
    assert [label(*g) for g in groups[8:12]] == ["9", "10-11", "12-13", "14-15"]
    assert [label(*g) for g in base_groups(2001)[8:11]] == ["9", "10-49", "50-99"]
    assert [linear_width(n) for n in (76, 150, 300, 1001)] == [2, 5, 5, 20]
    assert len(base_groups(16, min_length=20)) == 20


@pytest.mark.parametrize(("n", "text"), [(999, "999 bp"), (1590, "1.5 kbp"), (1050, "1 kbp"), (2_000_000, "2 Mbp"), (7_350_000_000, "7.3 Gbp"), (0, "0 bp")])
def test_base_total(n, text):
    assert stats.base_total(n) == text


@pytest.mark.parametrize(("x", "text"), [(0.0, "0.0"), (-0.0, "-0.0"), (1e7, "1.0E7"), (123456.5, "123456.5"), (0.001, "0.001"), (0.00012, "1.2E-4"), (float("nan"), "NaN"), (-float("inf"), "-Infinity"), (100.0, "100.0"), (9999999.0, "9999999.0")])
def test_double_text(x, text):
    assert stats.double_text(x) == text


@given(st.floats(allow_nan=False, allow_infinity=False))
def test_double_text_round_trips(x):
    assert float(stats.double_text(x)) == x


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 60), st.floats(0.01, 0.99), st.data())
def test_binomial_tail(n, p, data):
    k = data.draw(st.integers(0, n))
    want = math.fsum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1, n + 1))
    assert stats.binomial_above(n, p, k) == pytest.approx(want, abs=1e-12)


def test_gc_summary_of_one_read_is_undefined():
    mode, stdev, deviation, _ = stats.gc_summary([1.0] + [0.0] * 100)
    assert mode == 0 and math.isnan(stdev) and math.isnan(deviation)
    assert verdicts.gc_content(deviation, Limits()) == "pass"


def test_contaminants():
    rng = random.Random(5)
    dna = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    a, b = dna(60), dna(40)
    turned = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    listed = [("a", a), ("b", b)]
    assert best_hit(a[:50], listed) == ("a", 50, 100)
    assert best_hit(turned(b), listed)[0] == "b"
    assert best_hit(a[3:15], listed) == ("a", 12, 100)  # short: exact only
    assert best_hit(dna(7), listed) is None
    one = a[:20] + ("A" if a[20] != "A" else "C") + a[21:50]
    assert best_hit(one, listed) == ("a", 50, 98)
    assert best_hit(dna(30), listed) is None
    assert hit_text(best_hit(one, listed)) == "a (98% over 50bp)" and hit_text(None) == "No Hit"


def test_lengths():
    assert composition.length_plan(16, 16) == (15, 1, 3)
    assert composition.length_plan(100, 300)[1] == 5
    assert verdicts.length_distribution([5], Limits()) == "pass"
    assert verdicts.length_distribution([5, 6], Limits()) == "warn"
    assert verdicts.length_distribution([0, 6], Limits()) == "fail"


def test_config():
    limits = Limits("# no\nkmer ignore 0\nbad line x\ntile\twarn\t7\n\n")
    assert limits.get("tile", "warn") == 7 and limits.enabled("kmer") and limits.get("line", "x", 3) == 3
    assert read_pairs("#x\ty\nname one\t\tACGT\nshort\n") == [("name one", "ACGT")]
    with pytest.raises(ValueError):
        QcConfig(kmer_size=11)
    with pytest.raises(ValueError):
        QcConfig(format="cram")


def _fastq(text, **flags):
    return list(records.fastq(io.BytesIO(text.encode()), "x", **flags))


def test_fastq():
    assert _fastq("\n\n@a\nacgt\n+\nIIII\r\n") == [("@a", "ACGT", "IIII", False, None)]
    assert _fastq("@a 1:Y:18\nA\n+\nI\n", casava=True)[0][3] and not _fastq("@a 1:Y:18\nA\n+\nI\n")[0][3]
    assert not _fastq("@a 1:Y:18\nA\n+\nI\n", casava=True, nofilter=True)[0][3]
    for bad in ("a\nA\n+\nI\n", "@a\nA\nI\nI\n", "@a\nA\n+\n"):
        with pytest.raises(ValueError):
            _fastq(bad)


@pytest.mark.parametrize(("colors", "bases"), [("A0", "A"), ("A01", "AC"), ("G10", "TT"), ("A.12", "NNN"), ("A04", "AN")])
def test_colorspace(colors, bases):
    assert records.decode_colors(colors) == bases
    assert _fastq(f"@a\n{colors}\n+\nIIII\n")[0][1] == bases


def _bam(flag, cigar, sequence, quality):
    name = b"r1\0"
    ops = b"".join(struct.pack("<I", n << 4 | records.BAM_CIGAR.index(o)) for n, o in cigar)
    codes = [records.BAM_BASES.index(b) for b in sequence] + [0]
    packed = bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(sequence), 2))
    body = struct.pack("<iiBBHHHiiii", 0, 0, len(name), 0, 0, len(cigar), flag, len(sequence), -1, -1, 0) + name + ops + packed + bytes(ord(q) - 33 for q in quality)
    return b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 2) + b"c\0" + struct.pack("<i", 9) + struct.pack("<i", len(body)) + body


@pytest.mark.parametrize("flag", [0, 4, 16, 512])
@pytest.mark.parametrize("mapped", [False, True])
def test_bam_and_sam_agree(tmp_path, flag, mapped):
    sequence, quality = "AACCGGTTN", "ABCDEFGHI"
    sam = f"@HD\tx\nr1\t{flag}\tc\t1\t0\t2S6M1S\t*\t0\t0\t{sequence}\t{quality}\n"
    data = _bam(flag, [(2, "S"), (6, "M"), (1, "S")], sequence, quality)
    path = tmp_path / "x.bam"
    path.write_bytes(gzip.compress(data[:20]) + gzip.compress(data[20:]))
    got = list(records.records(str(path), "bam_mapped" if mapped else "bam"))
    assert got == list(records.sam(io.BytesIO(sam.encode()), "", mapped))
    if mapped and flag == 4:
        assert got == []
    elif mapped and flag == 16:
        assert got[0][1:3] == ("AACCGG", "HGFEDC")
    else:
        assert got[0][3] == (flag == 512)


def test_compressed_and_names(tmp_path):
    text = b"@a\nAC\n+\nII\n"
    for name, data in (("a.fastq", text), ("b.fastq.gz", gzip.compress(text) + gzip.compress(text.replace(b"@a", b"@b"))), ("c.fastq.bz2", bz2.compress(text)), ("odd", gzip.compress(text))):
        (tmp_path / name).write_bytes(data)
        assert len(list(records.records(str(tmp_path / name), "fastq"))) == (2 if name[0] == "b" else 1)
    assert [file_kind(x) for x in ("a.BAM", "a.ubam", "a.sam", "a.fast5", "a.txt")] == ["bam", "bam", "sam", "fast5", "fastq"]
    assert casava_name("/d/SampleA_S1_L001_R1_001.fastq.gz") == "SampleA_S1_L001_R1.fastq.gz" and casava_name("plain.fastq") == "plain.fastq"
    assert grouped(["s_001.fastq", "t.fastq", "s_002.fastq"], True) == [("s.fastq", ["s_001.fastq", "s_002.fastq"]), ("t.fastq", ["t.fastq"])]
    assert nanopore_name("a_b_c_d.fast5") == "a_b_c"
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "x.FAST5").write_bytes(b"")
    assert expand([str(tmp_path)], True) == [str(tmp_path / "deep" / "x.FAST5")]


def test_standard_input_is_spooled():
    path = spooled("stdin", io.BytesIO(gzip.compress(b"@a\nAC\n+\nII\n")))
    assert len(list(records.records(path, "fastq"))) == 1 and spooled("x.fastq") == "x.fastq"
    os.remove(path)


def test_seeded_contaminant_search_misses_nothing():
    import random

    from strandmill.functions import contaminants as module

    rng = random.Random(5)
    base = lambda n: "".join(rng.choice("ACGT") for _ in range(n))

    def plain(query, listed):
        best = None
        for name, sequence in listed:
            for strand in (sequence, module._turned(sequence)):
                if 8 <= len(query) < 20:
                    found = [(len(query), 100)] if query in strand else []
                else:
                    found = []
                    for offset in range(20 - len(strand), len(query) - 20):
                        lo, hi = max(0, -offset), min(len(strand), len(query) - offset)
                        equal = np.array([strand[i] == query[i + offset] for i in range(lo, hi)], bool)
                        found += [(n, (n - bad) * 100 // n) for n, bad in module._stretches(equal) if n > 20] if hi - lo > 20 else []
                for length, identity in found:
                    if best is None or (length, identity) > best[1:]:
                        best = (name, length, identity)
        return best

    hits = 0
    for _ in range(150):
        listed = [(f"c{k}", base(rng.randrange(15, 60))) for k in range(3)]
        own = rng.choice(listed)[1]
        own = own if rng.random() < 0.5 else module._turned(own)
        query = list(base(rng.randrange(0, 12)) + own[rng.randrange(0, 6) :] + base(rng.randrange(0, 12)))
        for _ in range(rng.randrange(0, 3)):
            query[rng.randrange(len(query))] = rng.choice("ACGTN")
        assert best_hit("".join(query), listed) == plain("".join(query), listed)
        hits += plain("".join(query), listed) is not None
    assert hits > 60


def test_contaminants_are_known_by_default():
    from strandmill.config import QcConfig

    known = QcConfig().contaminants
    assert len(known) == 151 and len({n for n, _ in known}) > 140 and all(set(s) <= set("ACGTN") for _, s in known)
    assert hit_text(best_hit("GATCGGAAGAGCTCGTATGCCGTCTTCTGCTTGAAAAAAAAAAAAAAAAAA", known)) == "Illumina Single End Adapter 1 (100% over 33bp)"


def test_steps_of_high_levels_are_bounded(spark):
    from pyspark.sql import functions as F

    from strandmill.operators.duplication import corrected

    df = spark.createDataFrame([(10**9, 3, 10**6, 10**10), (5, 7, 300, 9000), (40, 1, 300, 9000)], "n long, seen long, lim long, total long")
    got = [r.u for r in df.select(corrected(F.col("n"), F.col("seen"), F.col("lim"), F.col("total")).alias("u")).collect()]
    miss = lambda n: math.prod((9000 - 300 - j) / (9000 - j) for j in range(n))
    assert got[0] == 3 and got[1:] == pytest.approx([7 / (1 - miss(5)), 1 / (1 - miss(40))])
