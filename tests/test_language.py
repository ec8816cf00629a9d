"""The script language: tokens, syntax, checks, and results in both profiles."""

import warnings

import pytest
from matrices import TEXTS
from test_operators import GFF, TEST

from strandline.plans.errors import LexicalError, SemanticError, SyntaxErrors
from strandline.plans.session import Session
from strandline.plans.syntax import Both, Compare, Find, Not, parse, tokenize

DEMO = [
    'LOAD SEQUENCE "{dir}/test.fasta" AS bases; FIND MOTIF "CA" STRAND NEGATIVE;',
    'LOAD SEQUENCE "{dir}/test.fasta" AS bases; FIND MOTIF "TTGA" AS boxes; EXTRACT boxes WHERE SIMILARITY > 62.5% OR LENGTH < 3 BP;',
    'LOAD ANNOTATION "{dir}/mini.gff3" AS marks; EXTRACT TSS; EXTRACT PROMOTER AS before WHERE NOT LENGTH > 0.2 KB; UNION before AND EXON AS parts; EXCEPT parts FROM CDS;',
    'LOAD SEQUENCE "{dir}/test.fasta" AS bases; LOAD ANNOTATION "{dir}/mini.gff3" AS marks; FIND MOTIF "GGAGG" WITHIN 1 KB UPSTREAM FROM CDS AS sites; INTERSECT sites AND GENE WHERE LENGTH <= 5;',
    'LOAD SEQUENCE "{dir}/test.fasta" AS bases; FIND MOTIF "C[CG]A" AS caps; FIND MOTIF "A(.)T" WITHIN 30 BP UPSTREAM FROM caps AS arms WHERE LENGTH = 3 BP; UNION arms AND caps;',
    'LOAD SEQUENCE "{dir}/test.fasta" AS bases; LOAD MATRIX "{dir}/MA0108.1_TBP.pwm" AS weights; SCAN weights STRAND NEGATIVE THRESHOLD 55% AS low; SCAN weights THRESHOLD 90%; EXCEPT low FROM low;',
]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("scripts")
    (d / "test.fasta").write_text(f">test_sequence Sample\n{TEST}\n>second\nACACAC\n")
    (d / "mini.gff3").write_text(GFF + "\n")
    for name, text in TEXTS.items():
        (d / f"{name}.pwm").write_text(text)
    return str(d)


def run(spark, folder, script, profile="documented"):
    return Session(spark, profile).run(script.replace("{dir}", folder))


HEAD = 'LOAD SEQUENCE "{dir}/test.fasta" AS seq; LOAD ANNOTATION "{dir}/mini.gff3" AS ann; '


def names(result):
    return [r.name for r in result.frame.orderBy("ord").collect()]


def places(result):
    return sorted((r.chr, r.start, r.strand) for r in result.frame.collect())


def test_tokens_and_syntax():
    kinds = [t.kind for t in tokenize('FIND a1 "x" 1 2.5 >= % -- rest\n// rest\n/* more\n*/ ;')]
    assert kinds == ["FIND", "ID", "STRING", "NUM", "FLOAT", ">=", "%", ";", "END"]
    assert (tokenize("\n  EXTRACT")[0].line, tokenize("\n  EXTRACT")[0].column) == (2, 3)
    for bad in ("/", "#", '"open', "a - b"):
        with pytest.raises(LexicalError):
            tokenize(bad)
    s = parse('FIND MOTIF "A" STRAND POSITIVE STRAND NEGATIVE CHR "c" WITHIN 5 KB UPSTREAM FROM GENE "n" AS x WHERE NOT LENGTH > 1 AND LENGTH < 2 OR (SIMILARITY = 3 %);')[0]
    assert isinstance(s, Find) and s.strand == "-" and s.chr == "c" and (s.within.distance, s.within.unit, s.within.name) == (5, "KB", "n")
    assert isinstance(s.where, Both) and s.where.op == "OR" and isinstance(s.where.left.left, Not) and isinstance(s.where.right, Compare)
    with pytest.raises(SyntaxErrors) as e:
        parse('FIND "A"; EXTRACT; SCAN m THRESHOLD x; LOAD FILE "a" AS b; COUNT a; UNION a OR b')
    assert len(e.value.errors) == 6
    assert parse("EXCEPT a AND b; EXCEPT a FROM b AS c;")[1].alias == "c"


@pytest.mark.parametrize(
    "script",
    [
        "EXTRACT GENE;", "EXTRACT nothing;", "SCAN nothing;", 'FIND MOTIF "A";', 'LOAD SEQUENCE "{dir}/none" AS s;',
        'LOAD SEQUENCE "{dir}/test.fasta" AS s; LOAD MATRIX "{dir}/MA0108.1_TBP.pwm" AS s;', 'LOAD SEQUENCE "{dir}/test.fasta" AS s; SCAN s;',
        'LOAD SEQUENCE "{dir}/test.fasta" AS s; EXTRACT s;', 'LOAD SEQUENCE "{dir}/test.fasta" AS s; FIND MOTIF "A" WITHIN 5 BP UPSTREAM FROM x AS x;',
        'LOAD SEQUENCE "{dir}/test.fasta" AS s; LOAD MATRIX "{dir}/MA0108.1_TBP.pwm" AS t; SCAN t THRESHOLD 101%;',
        HEAD + "EXTRACT GENE WHERE SIMILARITY > 100.5%;", HEAD + 'EXTRACT GENE WHERE LENGTH > "5";',
    ],
)
def test_semantic_errors(spark, folder, script):
    with pytest.raises(SemanticError):
        run(spark, folder, script)


@pytest.mark.parametrize("profile", ["documented", "observed"])
@pytest.mark.parametrize("script", DEMO)
def test_demo_scripts_run(spark, folder, script, profile):
    for r in run(spark, folder, script, profile):
        assert r.text().startswith("  ")


def test_golden(spark, folder):
    found = run(spark, folder, HEAD + 'EXTRACT GENE; INTERSECT GENE AND CDS; EXCEPT GENE FROM EXON; UNION GENE AND EXON; FIND MOTIF "AC" WITHIN 10 BP UPSTREAM FROM GENE; FIND MOTIF "AC" WITHIN 10 BP DOWNSTREAM FROM GENE "geneA";')
    assert [(r.name, r.sequence) for r in found[0].frame.orderBy("ord").collect()] == [("geneA", "ACGATCGTAC"), ("geneB", "CGTTAACGCT")]
    assert [(r.name, r.type) for r in found[1].frame.collect()] == [("geneA", "gene ∩ CDS")]
    assert names(found[2]) == ["geneA"]
    assert [(r.start, r.end, r.type, r.sequence) for r in found[3].frame.orderBy("ord").collect()] == [(10, 20, "gene", "ACGATCGTAC"), (30, 45, "union", "CGTTAACGCTAGCGT")]
    assert [(r.position, r.strand) for r in found[4].frame.orderBy("ord").collect()] == [(5, "-"), (8, "-"), (43, "-"), (45, "+")]
    assert [(r.position, r.strand) for r in found[5].frame.orderBy("ord").collect()] == [(21, "-"), (23, "+")]
    text = found[0].text()
    assert "Found 2 region(s):" in text and "[1] test_sequence:10..20  length:10 BP  strand:+  type:gene  name:geneA" in text


def test_records_and_chr(spark, folder):
    script = 'LOAD SEQUENCE "{dir}/test.fasta" AS s; FIND MOTIF "AC" STRAND POSITIVE CHR "second" AS p; EXTRACT p;'
    assert places(run(spark, folder, script)[-1]) == [("second", 0, "+"), ("second", 2, "+"), ("second", 4, "+")]
    assert [p[1] for p in places(run(spark, folder, script, "observed")[-1])] == [10, 18, 23, 35, 45]


def test_boolean_logic(spark, folder):
    script = HEAD + "EXTRACT GENE WHERE {c};"

    def of(condition, profile="documented"):
        return names(run(spark, folder, script.replace("{c}", condition).replace("GENE", "CDS"), profile)[-1]), names(run(spark, folder, script.replace("{c}", condition), profile)[-1])

    assert of("LENGTH > 100 OR LENGTH < 10") == (["cdsA"], [])
    assert of("LENGTH > 100 OR LENGTH < 10", "observed") == ([], [])
    assert of("NOT LENGTH > 9 BP") == (["cdsA"], [])
    assert of("NOT LENGTH > 9 BP", "observed") == ([], ["geneA", "geneB"])
    assert of("NOT (LENGTH = 9 OR LENGTH = 10)") == ([], [])
    assert of("SIMILARITY > 90%") == (["cdsA"], ["geneA"])
    assert of("SIMILARITY > 90% OR LENGTH = 10") == (["cdsA"], ["geneA", "geneB"])


def test_units(spark, folder):
    script = HEAD + "EXTRACT PROMOTER WHERE LENGTH > 0.2 KB;"
    assert names(run(spark, folder, script)[-1]) == ["geneB_promoter"]
    assert len(names(run(spark, folder, script, "observed")[-1])) == 2
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        run(spark, folder, HEAD + "EXTRACT GENE WHERE LENGTH > 5 % AND SIMILARITY >= 0 KB;")
    assert len(seen) == 2


def test_alias_and_where(spark, folder):
    script = HEAD + 'FIND MOTIF "AC" STRAND POSITIVE AS p WHERE LENGTH > 5; EXTRACT p; FIND MOTIF "AC" STRAND POSITIVE WHERE LENGTH > 5;'
    documented, observed = run(spark, folder, script), run(spark, folder, script, "observed")
    assert [r.frame.count() for r in documented] == [0, 0, 0]
    assert [r.frame.count() for r in observed] == [0, 5, 5]


def test_scan(spark, folder):
    script = 'LOAD SEQUENCE "{dir}/test.fasta" AS s; LOAD MATRIX "{dir}/MA0002.2_RUNX1.pwm" AS r; SCAN r; SCAN r THRESHOLD 60% AS hits; SCAN r STRAND POSITIVE THRESHOLD 0% WHERE LENGTH = 11;'
    found = run(spark, folder, script)
    assert [(r.position, r.strand) for r in found[0].frame.collect()] == [(0, "-")]
    assert places(found[1]) == sorted(("test_sequence", p, s) for s, v in (("+", [1, 6, 14, 31]), ("-", [0, 32, 38])) for p in v)
    assert found[2].frame.count() == 40
    assert "match(es)" in found[0].text()
    assert run(spark, folder, script.replace(" WHERE LENGTH = 11", ""), "observed")[2].frame.count() == 0


def test_regex_errors(spark, folder):
    script = 'LOAD SEQUENCE "{dir}/test.fasta" AS s; FIND MOTIF "(A";'
    with pytest.raises(ValueError):
        run(spark, folder, script)
    assert run(spark, folder, script, "observed")[0].text() == "  No matches found."


def test_composition_of_sets(spark, folder):
    script = HEAD + "UNION GENE AND CDS AS u; EXCEPT u FROM EXON AS v; EXTRACT v;"
    assert names(run(spark, folder, script)[-1]) == ["cdsA"]
    session = Session(spark)
    session.run(HEAD.replace("{dir}", folder) + "EXTRACT GENE AS g;")
    assert names(session.run("EXTRACT g;")[0]) == ["geneA", "geneB"]
    told = session.describe("EXTRACT g;", session.run("EXTRACT g;"))
    assert "features: gene 2" in told and "checks: passed" in told and "plan of result 1:" in told
    assert "checks: passed" not in session.describe("EXTRACT g WHERE SIMILARITY > 200;")


def test_command_line(spark, folder, capsys, tmp_path):
    from strandline.plans.__main__ import main

    script = tmp_path / "s.txt"
    script.write_text(HEAD.replace("{dir}", folder) + "EXTRACT CDS; EXTRACT GENE;")
    assert main([str(script)]) == 0
    assert "Found 2 region(s)" in capsys.readouterr().out
    assert main(["--debug", str(script)]) == 0
    shown = capsys.readouterr().out
    assert "Found 1 region(s)" in shown and "name: ann (annotation)" in shown
    script.write_text("EXTRACT;")
    assert main([str(script)]) == 1 and "SyntaxErrors" in capsys.readouterr().err
    assert main([]) == 2


def test_sets_of_set_operations_are_searched_once(spark, folder, monkeypatch):
    script = HEAD + 'FIND MOTIF "AC" AS a; FIND MOTIF "GT" AS b; FIND MOTIF "TA" AS alone; UNION a AND b AS ab; EXCEPT ab FROM GENE AS rest; INTERSECT rest AND a;'
    once = run(spark, folder, script)
    plan = once[-1].frame._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "FileScan parquet" in plan
    assert "MapInArrow" in once[2].frame._jdf.queryExecution().executedPlan().toString()  # no operation reads it
    monkeypatch.setattr("strandline.sources.tables.shared_folder", lambda _: None)
    lazy = run(spark, folder, script)
    for x, y in zip(once, lazy, strict=True):
        assert sorted(map(str, x.frame.collect())) == sorted(map(str, y.frame.collect()))
