"""Operators against golden values and naive versions."""

import math
import random
import re

import matrices
import pytest
from pyspark.sql import functions as F

from strandline.functions import alignment, dna, pssm
from strandline.operators import motif, pwm, regions, similarity, within
from strandline.sources import fasta, gff3, jaspar

TEST = "ATGCCGTAGTACGATCGTACGGTACCTGATCGTTAACGCTAGCGTACGAT"
GFF = "\n".join(
    "\t".join(x)
    for x in [
        ("test_sequence", ".", "gene", "11", "20", ".", "+", ".", "ID=g1;Name=geneA"),
        ("test_sequence", ".", "CDS", "11", "19", ".", "+", "0", "ID=c1;Name=cdsA"),
        ("test_sequence", ".", "gene", "31", "40", ".", "-", ".", "ID=g2;Name=geneB"),
        ("test_sequence", ".", "exon", "36", "45", ".", "-", ".", "ID=e1"),
    ]
)


@pytest.fixture(scope="module")
def seq(spark):
    return spark.createDataFrame([("test_sequence", TEST)], "seq_id string, sequence string")


def at(df, strand):
    return sorted(r.position for r in df.collect() if r.strand == strand)


@pytest.mark.parametrize("long_records", [False, True])
@pytest.mark.parametrize(
    ("pattern", "plus", "minus"),
    [
        ("AC", [10, 18, 23, 35, 45], [5, 8, 16, 21, 31, 43]),
        ("gtac", [8, 16, 21, 43], []),
        ("TACG", [9, 17, 44], [4, 15, 42]),
        ("CG[AT]", [4, 11, 15, 30, 42, 46], [10, 14, 18, 29, 35, 45]),
        ("ATG(...)*?(TAA|TAG|TGA)", [0], []),
        ("NNN", [], []),
    ],
)
def test_find(seq, pattern, plus, minus, long_records):
    hits = motif.find(seq, pattern, long_records=long_records)
    assert (at(hits, "+"), at(hits, "-")) == (plus, minus)
    for r in hits.collect():
        assert r.context == TEST[max(r.position - 20, 0) : r.position + r.match_length + 20]
    assert at(motif.find(seq, pattern, "-", long_records=long_records), "-") == minus
    assert motif.find(seq, pattern, seq_id="other").count() == 0


def test_pieces_give_what_whole_sequences_give(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(f"s{k}", "".join(rng.choice("ACGT") for _ in range(n))) for k, n in enumerate([0, 1, 3, 40_000, 16_384, 16_385])], "seq_id string, sequence string")
    for pattern in ("ACA", "AAAA", "GATTAC"):
        whole, cut = (sorted(map(tuple, motif.find_literal(df, pattern, long_records=x).collect())) for x in (False, True))
        assert whole == cut
        want = sum(len(re.findall(f"(?={p})", r.sequence)) for r in df.collect() for p in {pattern, dna.revcomp(pattern)})
        assert len(whole) == want


def test_find_edges(spark, seq):
    assert motif.find(seq, "").count() == 0
    low = spark.createDataFrame([("a", "acgtNRYK"), ("b", None), ("c", "")], "seq_id string, sequence string")
    assert at(motif.find(low, "CG"), "+") == [1]
    assert at(motif.find_literal(low, "acgt", fold_palindromes=False), "-") == [0]
    assert motif.find(low, "A*?").count() == 2 * (8 + 1 + 1 + 1 + 1)
    with pytest.raises(motif.PatternError):
        motif.find(seq, "(AC")
    assert motif.find(seq, "(AC", errors=False).count() == 0
    assert [r.rc for r in low.select(dna.reverse_complement(F.col("sequence")).alias("rc")).collect()] == ["NNNNACGT", None, ""]


@pytest.mark.parametrize(
    ("name", "length", "top", "low", "plus", "minus"),
    [
        ("MA0002.2_RUNX1", 11, 14.801069, -27.963585, [1, 6, 14, 31], [0, 32, 38]),
        ("MA0003.4_TFAP2A", 12, 16.729709, -25.685302, [18], []),
        ("MA0079.5_SP1", 12, 18.122239, -65.902760, [], []),
        ("MA0108.1_TBP", 12, 14.748879, -44.991754, [5, 21, 30], [0, 20, 26, 27]),
        ("MA0139.1_CTCF", 19, 22.891907, -57.226959, [15], [6, 7, 29]),
    ],
)
def test_scan(spark, seq, name, length, top, low, plus, minus):
    m = pssm.pssm(jaspar.parse_jaspar(matrices.TEXTS[name]))
    assert m.length == length and math.isclose(m.max_score, top, abs_tol=1e-6) and math.isclose(m.min_score, low, abs_tol=1e-6)
    hits = pwm.scan(seq, m, threshold=60)
    assert (at(hits, "+"), at(hits, "-")) == (plus, minus)
    for sign, want in (("+", plus), ("-", minus)):
        assert sorted(r.position for r in pwm.scan_native(seq, m, sign, 60).collect()) == want
        assert at(pwm.scan(seq, m, sign, 60), sign) == want
    rest = pwm.scan(seq, m, scores=True).collect()
    assert [(r.position, r.strand, round(r.score, 6)) for r in rest] == ([(0, "-", 4.347895)] if "RUNX1" in name else [])
    best = "".join(max("ACGT", key=lambda b, j=j: -1e9 if m.scores["ACGT".index(b)][j] is None else m.scores["ACGT".index(b)][j]) for j in range(m.length))
    word = spark.createDataFrame([("w", best), ("n", best[:3] + "N" + best[4:]), ("s", best[:-1])], "seq_id string, sequence string")
    assert [r.seq_id for r in pwm.scan(word, m, "+", 100).collect()] == ["w"]
    assert pssm.percent(m, m.max_score) == 100 and pssm.percent(m, m.min_score - 1) == 0


def test_scan_of_pieces_equals_scan_of_records(spark):
    rng = random.Random(2)
    rows = [(n, "".join(rng.choice("ACGTacgtN") for _ in range(size))) for n, size in (("a", 50_000), ("b", 16_384), ("c", 16_390), ("d", 8))]
    df = spark.createDataFrame([*rows, ("e", None), ("f", "")], "seq_id string, sequence string").coalesce(1)
    m = pssm.pssm(jaspar.parse_jaspar(matrices.TEXTS["MA0002.2_RUNX1"]))
    whole, cut = (sorted(map(tuple, pwm.scan(df, m, threshold=50, scores=True, long_records=x).collect())) for x in (False, True))
    assert whole == cut and len(whole) > 1000
    assert {p // 16_384 for n, p, *_ in cut if n == "a"} == {0, 1, 2, 3}


def test_overlaps_of_a_dense_bin(spark):
    """Regions that all begin in few places are few rows once they are aggregated."""
    schema = "chr string, start long, end long, strand string, type string, name string, sequence string"
    b = spark.range(0, 20_000, 1, 4).select(F.lit("x").alias("chr"), (F.col("id") % 3 * 100).alias("start"), (F.col("id") % 3 * 100 + 1 + F.col("id") % 40).alias("end"), F.lit("+").alias("strand"), F.lit("b").alias("type"), F.col("id").cast("string").alias("name"), F.lit("").alias("sequence"))
    a = spark.createDataFrame([("x", s, s + 1, "+", "a", f"a{s}", "") for s in range(300)], schema)
    assert sorted(r.start for r in regions.intersect(a, b).collect()) == [s for s in range(300) if s % 100 < 40]
    assert sorted(r.start for r in regions.except_(a, b, 64).collect()) == [s for s in range(300) if s % 100 >= 40]


def test_jaspar_forms():
    m = jaspar.parse_jaspar(">id\n1 2x 3\n4 5 6\n\n7 8 9e0\n[ 1 1 -2.5 ]\n", "f")
    assert (m.id, m.name, m.counts) == ("id", "id", ((1, 2, 3), (4, 5, 6), (7, 8, 9), (1, 1, -2.5)))
    assert pssm.pssm(m).scores[3][2] is None
    for bad in ("", ">x\nA 1\nC 1\nG 1\n", "A 1 2\nC 1\nG 1\nT 1\n", "1\n1\n1\n1\n1\n"):
        with pytest.raises(ValueError):
            jaspar.parse_jaspar(bad)


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_bytes(b"junk\nmore\n>one first record\r\nacg\r\nT N\n\n>two\n>three x\nAC\tGT\nGG")
    rows = fasta.read_fasta(spark, str(tmp_path / "a.fa")).orderBy("ord").collect()
    assert [(r.seq_id, r.header, r.sequence) for r in rows] == [("one", "one first record", "ACGTN"), ("two", "two", ""), ("three", "three x", "AC\tGTGG")]
    assert [r.seq_id for r in fasta.read_fasta(spark, str(tmp_path / "a.fa"), first_only=True).collect()] == ["one"]
    (tmp_path / "b.fa").write_text(">b\nAA\n")
    assert [(r.seq_id, r.sequence) for r in fasta.read_fasta(spark, str(tmp_path / "b.fa")).collect()] == [("b", "AA")]
    (tmp_path / "c.fa").write_text("no record\n")
    assert fasta.read_fasta(spark, str(tmp_path / "c.fa")).count() == 0


@pytest.fixture(scope="module")
def features(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("gff") / "mini.gff3"
    path.write_text("##gff-version 3\n\n" + GFF + "\nbroken row\nx\t.\tgene\t0\t5\t.\t+\t.\tID=z\n##FASTA\ntest_sequence\t.\tgene\t1\t2\t.\t+\t.\tName=late\n")
    return gff3.read_gff3(spark, str(path)), str(path)


def shown(df, order="ord"):
    rows = df.orderBy(order).collect() if order else df.collect()
    return [(r.name, r.start, r.end, r.strand) for r in rows]


def test_gff3(spark, features):
    df, path = features
    assert shown(df) == [("geneA", 10, 20, "+"), ("cdsA", 10, 19, "+"), ("geneB", 30, 40, "-"), ("e1", 35, 45, "-"), ("geneA_promoter", 0, 10, "+"), ("geneA_TSS", 10, 11, "+"), ("geneB_promoter", 40, 290, "-"), ("geneB_TSS", 39, 40, "-")]
    assert len(shown(gff3.read_gff3(spark, path, strict=False))) == 8 + 2
    rows = spark.createDataFrame([("x", "geneName=no;Name=yes;ID=i"), ("y", "ID=i"), ("z", "")], "k string, a string")
    assert [r.v for r in rows.select(gff3.attribute(F.col("a"), "Name").alias("v")).collect()] == ["yes", "", ""]
    assert [r.v for r in rows.select(gff3.attribute(F.col("a"), "Name", False).alias("v")).collect()][0] == "no"


def test_region_sets(spark, seq, features):
    df, _ = features
    gene, cds, exon = (regions.of_type(df, t) for t in ("GENE", "CDS", "EXON"))
    both = regions.intersect(gene, cds).collect()
    assert [(r.name, r.type) for r in both] == [("geneA", "gene ∩ CDS")]
    assert shown(regions.except_(gene, exon)) == [("geneA", 10, 20, "+")]
    merged = sorted((r.start, r.end, r.type, r.name, r.strand) for r in regions.union(gene, exon).collect())
    assert merged == [(10, 20, "gene", "geneA", "+"), (30, 45, "union", "geneB", "-")]
    filled = {r.name: r.sequence for r in regions.attach_sequence(df, seq).collect()}
    assert filled["geneA"] == "ACGATCGTAC" and filled["geneB"] == "CGTTAACGCT" and filled["geneB_promoter"] == ""
    up = within.find_within(seq, "AC", gene, 10, "UPSTREAM")
    assert sorted((r.position, r.strand) for r in up.collect()) == [(5, "-"), (8, "-"), (43, "-"), (45, "+")]
    down = within.find_within(seq, "AC", gene, 10, "DOWNSTREAM").collect()
    assert sorted((r.position, r.strand) for r in down) == sorted([(21, "-"), (23, "+")] * 2)
    regex = within.find_within(seq, "A[C]", gene, 10, "DOWNSTREAM").collect()
    assert sorted((r.position, r.strand, r.context) for r in regex) == sorted((r.position, r.strand, r.context) for r in down)
    assert sorted(r.position for r in within.find_within(seq, "^.", gene, 10, "UPSTREAM", "+").collect()) == [0, 40]
    assert within.named(gene, "geneB").count() == 1 and within.named(gene, "none").count() == 2 and within.named(gene, "none", False).count() == 0


@pytest.mark.parametrize("size", [4, 16, 1 << 14])
def test_sets_equal_naive_ones(spark, size):
    rng = random.Random(size)

    def make(n, kind):
        return [(rng.choice("xy"), s := rng.randint(0, 120), s + rng.choice([0, 1, 3, 9, 30]), rng.choice("+-"), kind, f"{kind}{k}", "") for k in range(n)]

    a, b = make(60, "a"), make(15, "b")
    a += a[:5]
    schema = "chr string, start long, end long, strand string, type string, name string, sequence string"
    fa, fb = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    meets = {r for r in a if any(r[0] == q[0] and r[1] < q[2] and r[2] > q[1] for q in b)}
    kept = sorted((r.chr, r.start, r.end, r.name) for r in regions.intersect(fa, fb, size).collect())
    assert kept == sorted((r[0], r[1], r[2], r[5]) for r in a if r in meets)
    rest = sorted((r.chr, r.start, r.end, r.name) for r in regions.except_(fa, fb, size).collect())
    assert rest == sorted((r[0], r[1], r[2], r[5]) for r in a if r not in meets)
    want = []
    for r in sorted(a + b, key=lambda r: (r[0], r[1], r[2], r[3], r[5], r[4])):
        if want and want[-1][0] == r[0] and r[1] <= want[-1][2]:
            want[-1] = (*want[-1][:2], max(want[-1][2], r[2]), want[-1][3], "union", want[-1][5], want[-1][6] + 1)
        else:
            want.append((*r[:3], r[3], r[4], r[5], 1))
    got = sorted((r.chr, r.start, r.end, r.strand, r.type, r.name, r.n_members) for r in regions.union(fa, fb, size).collect())
    assert got == sorted(want)


def test_alignment():
    cases = [("ACACACTA", "AGCACACA", 10, 100), ("AC", "TTTACTTT", 4, 100), ("GATTACA", "GCATGCA", 5, 75), ("ACGATCGTAC", "CGTTAACGCT", 7, 80), ("AAAA", "CCCC", 0, 0), ("", "ACG", 0, 0)]
    for q, t, score, percent in cases:
        assert alignment.align(q, t)[0] == score and alignment.similarity(q, t) == percent
    assert alignment.align("GATTACA", "GCATGCA")[1:] == ("TACA", "TGCA")


def test_alignment_equals_plain_recursion():
    rng = random.Random(3)
    for _ in range(60):
        q, t = ("".join(rng.choice("ACGTa") for _ in range(rng.randint(1, 14))) for _ in "ab")
        h = {}
        best, spot = 0, (0, 0)
        for i in range(len(q) + 1):
            for j in range(len(t) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if q[i - 1].upper() == t[j - 1].upper() else -1), h[i - 1, j] - 2, h[i, j - 1] - 2) if i and j else 0
                if h[i, j] > best:
                    best, spot = h[i, j], (i, j)
        i, j = spot
        a = b = ""
        while i and j and h[i, j]:
            if h[i, j] == h[i - 1, j - 1] + (2 if q[i - 1].upper() == t[j - 1].upper() else -1):
                i, j, a, b = i - 1, j - 1, q[i - 1] + a, t[j - 1] + b
            elif h[i, j] == h[i - 1, j] - 2:
                i, a, b = i - 1, q[i - 1] + a, "-" + b
            else:
                j, a, b = j - 1, "-" + a, t[j - 1] + b
        assert alignment.align(q, t) == (best, a, b)


def test_alignments_side_by_side(monkeypatch):
    rng = random.Random(8)
    texts = ["", "a"] + ["".join(rng.choice("ACGTacgN") for _ in range(rng.randint(1, 60))) for _ in range(80)]
    for query in ("ACGTTGCA" * 4, "", "acg", "TTTTTTTTTTTT"):
        assert alignment.similarities(query, texts) == [alignment.similarity(query, t) for t in texts]
    monkeypatch.setattr(alignment, "SIDE", 300)
    assert alignment.similarities("ACGTTGCA", texts) == [alignment.similarity("ACGTTGCA", t) for t in texts]


def test_banded_alignment(monkeypatch):
    monkeypatch.setattr(alignment, "FULL", 100)
    assert alignment.similarity("ACGT" * 60, "ACGT" * 60) == 100
    assert alignment.similarity("ACGT" * 60, "T" + "ACGT" * 60) > 98
    assert alignment.similarity("A" * 120, "C" * 120) == 0


def test_banded_alignment_equals_its_recurrence(monkeypatch):
    """Cells by (row, place in the band): a band moves with the row, so the cell above has the same place."""
    monkeypatch.setattr(alignment, "FULL", 0)
    rng = random.Random(4)
    for m, n in ((1, 1), (5, 400), (400, 5), (130, 130), (200, 90), (700, 640)):
        q, t = ("".join(rng.choice("ACGT") for _ in range(k)) for k in (m, n))
        if m == n:
            t = q[:40] + t[:9] + q[52:] + "acg"
        w = max(50, min(m, len(t)) // 10)
        above, best = {}, 0
        for i in range(m):
            row = {}
            for k in range(2 * w + 1):
                if 0 <= (j := i - w + k) < len(t):
                    row[k] = max(0, above.get(k, 0) + (2 if q[i] == t[j].upper() else -1), above.get(k, 0) - 2, row.get(k - 1, 0) - 2)
                    best = max(best, row[k])
            above = row
        assert alignment.similarity(q, t) == min(100.0, best / (2 * min(m, len(t))) * 100)


def test_similarity_filter(spark):
    rows = [(k, n, s) for k, (n, s) in enumerate([("ref", "ACGATCGTAC"), ("same", "ACGATCGTAC"), ("eighty", "CGTTAACGCT"), ("none", ""), ("far", "TTTTTTTTTT")])]
    df = spark.createDataFrame(rows, "ord long, name string, sequence string")
    assert {r.name for r in similarity.filter_similarity(df, ">=", 90).collect()} == {"ref", "same", "far"}
    assert {r.name for r in similarity.filter_similarity(df, "=", 80.4).collect()} == {"ref", "eighty"}
    assert {r.name for r in similarity.filter_similarity(df, "<", 81).collect()} == {"ref", "eighty"}
    tied = df.withColumn("ord", F.lit(0))  # the first by the other columns alone is the first
    assert {r.name for r in similarity.filter_similarity(tied, ">", 101).collect()} == {"eighty"}


def test_pieces_give_the_bases_of_regions(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([(n, "".join(rng.choice("ACGT") for _ in range(size))) for n, size in (("a", 50_000), ("b", 16_384), ("c", 10))], "seq_id string, sequence string")
    rows = [(n, s, s + rng.choice([0, 1, 7, 20_000]), "+", "t", f"r{k}", "") for k, (n, s) in enumerate((rng.choice("abcd"), rng.randint(0, 50_000)) for _ in range(60))]
    rows += [("a", 0, 50_000, "+", "t", "all", ""), ("a", 0, 50_001, "+", "t", "over", ""), ("c", 2, 5, "+", "t", "has", "TTT"), ("b", 16_383, 16_384, "+", "t", "last", "")]
    regs = spark.createDataFrame(rows + rows[:2], "chr string, start long, end long, strand string, type string, name string, sequence string")
    whole, cut = (sorted(map(tuple, regions.attach_sequence(regs, df, long_records=x).collect())) for x in (False, True))
    assert whole == cut and any(len(r[6]) == 50_000 for r in cut)
    regex, long_ = (sorted(map(tuple, within.find_within(df, "AC+G", regs, 300, "UPSTREAM", long_records=x).collect())) for x in (False, True))
    assert regex == long_ and regex


def test_bed(spark, features, tmp_path):
    from strandline.sources.bed import to_bed, write_bed

    assert [r.value for r in to_bed(features[0].orderBy("ord").limit(1)).collect()] == ["test_sequence\t10\t20\tgeneA\t0\t+"]
    write_bed(features[0], str(tmp_path / "bed"))
    assert spark.read.text(str(tmp_path / "bed")).count() == features[0].count()
