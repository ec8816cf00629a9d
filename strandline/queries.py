"""The driver's queries on the engine's operators, each with its DuckDB SQL where SQL can express it.

Sequences are the A, C, G and T of each document; regions are the line items of each part, by ship day.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.dna import reverse_complement
from .functions.pssm import BASES, Pwm, percent_of, pssm
from .operators import motif, pwm, regions, within
from .operators.sequences import spread
from .operators.similarity import filter_similarity
from .plans.session import Session
from .sources.bed import write_bed
from .sources.fasta import read_fasta
from .sources.gff3 import derive_promoters, derive_tss, read_gff3
from .sources.jaspar import read_jaspar
from .sources.tables import shared_folder

MOTIF, PALINDROME, REGEX, NEAR = "CACA", "GTAC", "CG[AT]", "GATA"
#: An invented matrix of six positions; one count is so negative that it has no score.
MATRIX = Pwm("SL1", "demo", ((12, 1, 9, 2, 14, 7), (1, 9, 2, 3, 1, 4), (2, 8, 1, 13, 3, 5), (5, 2, 8, 2, 2, -3)))
SCORES = pssm(MATRIX)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq_id, sequence) of every document."""
    bases = F.upper(F.regexp_replace(F.coalesce("text", F.lit("")), "[^acgtACGT]", ""))
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select(F.col("doc_id").cast("string").alias("seq_id"), bases.alias("sequence"))


def items(spark: SparkSession, sf_dir: str, gene: str | None = None) -> DataFrame:
    """Regions of line items; with ``gene`` those of that return flag are genes."""
    start = F.datediff("l_shipdate", F.lit("1995-01-01").cast("date")).cast("long")
    flag = F.col("l_returnflag")
    kind = F.when(flag == gene, "gene").otherwise(flag) if gene else flag
    name = F.concat_ws("_", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.col("l_partkey").cast("string").alias("chr"), start.alias("start"), (start + F.col("l_quantity").cast("int")).alias("end"),
        F.when(F.col("l_linestatus") == "F", "+").otherwise("-").alias("strand"), kind.alias("type"), name.alias("name"), F.lit("").alias("sequence"),
    )


DNA = """d AS (
  SELECT CAST(doc_id AS VARCHAR) AS seq_id, upper(regexp_replace(coalesce(text, ''), '[^acgtACGT]', '', 'g')) AS seq FROM documents),
rc AS (SELECT seq_id, reverse(translate(seq, 'ACGT', 'TGCA')) AS seq FROM d)"""
ITEMS = """r AS (
  SELECT CAST(l_partkey AS VARCHAR) AS chr, date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS start,
    date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) + CAST(l_quantity AS INTEGER) AS "end",
    CASE l_linestatus WHEN 'F' THEN '+' ELSE '-' END AS strand, l_returnflag AS type,
    CAST(l_orderkey AS VARCHAR) || '_' || CAST(l_linenumber AS VARCHAR) AS name
  FROM lineitem)"""
MATCH = ["seq_id", "position", "match_length", "strand"]
REGION = ["chr", "start", "end", "strand", "type", "name"]
COLUMNS = 'chr, start, "end", strand, type, name'


def _literal(word: str, sign: str, source: str = "d", out: str = "") -> str:
    m = len(word)
    return f"""SELECT seq_id, position, CAST({m} AS BIGINT) AS match_length, '{sign}' AS strand{out} FROM (
      SELECT seq_id, seq, unnest(range(length(seq) - {m} + 1)) AS position FROM {source} WHERE length(seq) >= {m}) WHERE substr(seq, position + 1, {m}) = '{word}'"""


def _rc(word: str) -> str:
    return word[::-1].translate(str.maketrans("ACGT", "TGCA"))


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


# --- motifs

query("find_literal_pos", f"WITH {DNA} {_literal(MOTIF, '+')}")(lambda s, d: motif.find(dna(s, d), MOTIF, "+").select(*MATCH))
query("find_literal_neg", f"WITH {DNA} {_literal(_rc(MOTIF), '-')}")(lambda s, d: motif.find(dna(s, d), MOTIF, "-").select(*MATCH))
query("find_literal_both", f"WITH {DNA} {_literal(MOTIF, '+')} UNION ALL {_literal(_rc(MOTIF), '-')}")(lambda s, d: motif.find(dna(s, d), MOTIF).select(*MATCH))
query("find_literal_long", f"WITH {DNA} {_literal(MOTIF, '+')} UNION ALL {_literal(_rc(MOTIF), '-')}")(lambda s, d: motif.find(dna(s, d), MOTIF, long_records=True).select(*MATCH))
query("find_literal_palindrome", f"WITH {DNA} {_literal(PALINDROME, '+')}")(lambda s, d: motif.find(dna(s, d), PALINDROME.lower()).select(*MATCH))
_context = ", substr(seq, greatest(position - 20, 0) + 1, position + {m} + 20 - greatest(position - 20, 0)) AS context"
query("find_context", f"WITH {DNA} {_literal(MOTIF, '+', out=_context.format(m=len(MOTIF)))}")(lambda s, d: motif.find(dna(s, d), MOTIF, "+"))
query("find_chr", f"WITH {DNA} SELECT * FROM ({_literal(MOTIF, '+')}) WHERE seq_id = '497'")(lambda s, d: motif.find(dna(s, d), MOTIF, "+", seq_id="497").select(*MATCH))
# this pattern has one length and cannot overlap itself, so every place that matches is a match
_places = """SELECT seq_id, {pos} AS position, CAST(3 AS BIGINT) AS match_length, '{sign}' AS strand FROM (
  SELECT seq_id, seq, unnest(range(length(seq) - 2)) AS p FROM {source} WHERE length(seq) >= 3) WHERE regexp_full_match(substr(seq, p + 1, 3), '{regex}')"""
query("find_regex_pos", f"WITH {DNA} " + _places.format(pos="p", sign="+", source="d", regex=REGEX))(lambda s, d: motif.find(dna(s, d), REGEX, "+").select(*MATCH))
query("find_regex_neg", f"WITH {DNA} " + _places.format(pos="length(seq) - p - 3", sign="-", source="rc", regex=REGEX))(lambda s, d: motif.find(dna(s, d), REGEX, "-").select(*MATCH))
#: Non-overlapping matches from left to right: where the text of the next match first stands, the match begins.
_OPEN = f"""WITH RECURSIVE {DNA}, src AS (SELECT seq_id, '+' AS strand, seq FROM d UNION ALL SELECT seq_id, '-', seq FROM rc),
m(seq_id, strand, n, done, rest, hit) AS (
  SELECT seq_id, strand, length(seq), 0, seq, regexp_extract(seq, 'ATG(...)*?(TAA|TAG|TGA)') FROM src
  UNION ALL SELECT seq_id, strand, n, done + k - 1, substr(rest, k), regexp_extract(substr(rest, k), 'ATG(...)*?(TAA|TAG|TGA)')
  FROM (SELECT *, strpos(rest, hit) + length(hit) AS k FROM m WHERE hit <> '')),
h AS (SELECT seq_id, strand, n, done + strpos(rest, hit) - 1 AS p, CAST(length(hit) AS BIGINT) AS match_length FROM m WHERE hit <> '')
SELECT seq_id, CASE strand WHEN '+' THEN p ELSE n - p - match_length END AS position, match_length, strand FROM h"""
query("find_regex_open", _OPEN)(lambda s, d: motif.find(dna(s, d), "ATG(...)*?(TAA|TAG|TGA)").select(*MATCH))
query("revcomp", f"WITH {DNA} SELECT seq_id, seq AS rc FROM rc")(lambda s, d: dna(s, d).select("seq_id", reverse_complement(F.col("sequence")).alias("rc")))


@query("match_regions", f"WITH {DNA} SELECT seq_id AS chr, position AS start, position + match_length AS \"end\", strand, 'hit' AS type, 'hit_' || position AS name, substr(seq, position + 1, match_length) AS sequence FROM ({_literal(MOTIF, '+', out=', seq')})")
def match_regions(s: SparkSession, d: str) -> DataFrame:
    seqs = dna(s, d)
    return motif.as_regions(motif.find(seqs, MOTIF, "+"), "hit", seqs)


# --- matrices


def _scan_sql(sign: str, threshold: float, out: str = "") -> str:
    n = SCORES.length

    def cell(j: int) -> str:
        arms = " ".join(f"WHEN '{b}' THEN {SCORES.scores[k][j]!r}e0" for k, b in enumerate(BASES) if SCORES.scores[k][j] is not None)
        return f"CASE substr(seq, p + {j + 1}, 1) {arms} END"

    source, pos = ("d", "p") if sign == "+" else ("rc", f"length(seq) - p - {n}")
    total = " + ".join(cell(j) for j in range(n))
    return f"""SELECT seq_id, {pos} AS position, CAST({n} AS BIGINT) AS match_length, '{sign}' AS strand{out.format(total=total)} FROM (
      SELECT seq_id, seq, unnest(range(length(seq) - {n} + 1)) AS p FROM {source} WHERE length(seq) >= {n}) WHERE {total} >= {SCORES.least(threshold)!r}e0"""


query("scan_pwm_pos", f"WITH {DNA} {_scan_sql('+', 80)}")(lambda s, d: pwm.scan(dna(s, d), SCORES, "+", 80).select(*MATCH))
query("scan_pwm_neg", f"WITH {DNA} {_scan_sql('-', 80)}")(lambda s, d: pwm.scan(dna(s, d), SCORES, "-", 80).select(*MATCH))
query("scan_pwm_both", f"WITH {DNA} {_scan_sql('+', 90)} UNION ALL {_scan_sql('-', 90)}")(lambda s, d: pwm.scan(dna(s, d), SCORES, None, 90).select(*MATCH))
query("scan_pwm_default", f"WITH {DNA} {_scan_sql('+', 75)} UNION ALL {_scan_sql('-', 75)}")(lambda s, d: pwm.scan(dna(s, d), SCORES).select(*MATCH))


def _pssm_sql() -> str:
    cells = ", ".join(f"({j}, '{b}', {MATRIX.counts[k][j]}, {sum(r[j] for r in MATRIX.counts)})" for k, b in enumerate(BASES) for j in range(MATRIX.length))
    return f"""SELECT '{MATRIX.name}' AS matrix, CAST(pos AS INTEGER) AS pos, base,
      n + 0.8 > 0 AS has_score, CASE WHEN n + 0.8 > 0 THEN CAST(round(log2((n + 0.8e0) / (total + 3.2e0) / 0.25e0) * 1000000) AS BIGINT) ELSE 0 END AS score_micro FROM (VALUES {cells}) t(pos, base, n, total)"""


@query("pssm_table", _pssm_sql())
def pssm_table(s: SparkSession, d: str) -> DataFrame:
    cells = s.createDataFrame(pwm.pssm_rows(SCORES), "matrix string, pos int, base string, score double")
    micro = F.coalesce(F.round(F.col("score") * 1_000_000).cast("long"), F.lit(0).cast("long"))
    return cells.select("matrix", "pos", "base", F.col("score").isNotNull().alias("has_score"), micro.alias("score_micro"))


# --- regions

query("extract_type", f"WITH {ITEMS} SELECT {COLUMNS} FROM r WHERE type = 'R'")(lambda s, d: regions.of_type(items(s, d), "r").select(*REGION))
for _name, _op, _n in (("gt", ">", 45), ("lt", "<", 3), ("ge", ">=", 49), ("le", "<=", 2), ("eq", "=", 17), ("kb", ">", 0.0405)):
    _bases = _n * 1000 if _name == "kb" else _n
    query(f"extract_length_{_name}", f'WITH {ITEMS} SELECT {COLUMNS} FROM r WHERE "end" - start {_op} {_bases}')(lambda s, d, op=_op, n=_bases: regions.filter_length(items(s, d), op, n).select(*REGION))


def _extract(s: SparkSession, d: str, where: str) -> DataFrame:
    """Through the script language."""
    session = Session(s)
    session.register_regions("items", items(s, d).withColumn("ord", F.struct("chr", "start", "end", "name")))
    return session.run(f"EXTRACT items WHERE {where};")[0].frame.select(*REGION)


for _name, _where, _sql in (
    ("and", "LENGTH > 10 BP AND LENGTH < 13 BP", "n > 10 AND n < 13"),
    ("or", "LENGTH > 48 OR LENGTH < 0.003 KB", "n > 48 OR n < 3"),
    ("not", "NOT (LENGTH > 2 BP) OR NOT LENGTH < 50", "n <= 2 OR n >= 50"),
):
    query(f"extract_length_{_name}", f'WITH {ITEMS} SELECT {COLUMNS} FROM (SELECT *, "end" - start AS n FROM r) WHERE {_sql}')(lambda s, d, w=_where: _extract(s, d, w))

_GENES = "g AS (SELECT * FROM r WHERE type = 'A')"
query("derive_promoter", f"""WITH {ITEMS}, {_GENES} SELECT * FROM (SELECT chr, CASE strand WHEN '+' THEN greatest(start - 250, 0) ELSE "end" END AS start,
  CASE strand WHEN '+' THEN start ELSE "end" + 250 END AS "end", strand, 'promoter' AS type, name || '_promoter' AS name FROM g) WHERE start < "end" """)(lambda s, d: derive_promoters(items(s, d, "A")).select(*REGION))
query("derive_tss", f"""WITH {ITEMS}, {_GENES} SELECT chr, CASE strand WHEN '+' THEN start ELSE "end" - 1 END AS start,
  CASE strand WHEN '+' THEN start + 1 ELSE "end" END AS "end", strand, 'TSS' AS type, name || '_TSS' AS name FROM g""")(lambda s, d: derive_tss(items(s, d, "A")).select(*REGION))

_MEETS = 'FROM r b WHERE b.type = \'R\' AND b.chr = a.chr AND a.start < b."end" AND a."end" > b.start'
_PLACE = 'a.chr, a.start, a."end", a.strand'
query("region_intersect", f"WITH {ITEMS} SELECT {_PLACE}, 'A ∩ R' AS type, a.name FROM r a WHERE a.type = 'A' AND EXISTS (SELECT 1 {_MEETS})")(lambda s, d: regions.intersect(regions.of_type(items(s, d), "A"), regions.of_type(items(s, d), "R")).select(*REGION))
query("region_except", f"WITH {ITEMS} SELECT {_PLACE}, a.type, a.name FROM r a WHERE a.type = 'A' AND NOT EXISTS (SELECT 1 {_MEETS})")(lambda s, d: regions.except_(regions.of_type(items(s, d), "A"), regions.of_type(items(s, d), "R")).select(*REGION))


def _union_sql(where: str = "true", having: str = "") -> str:
    return f"""WITH {ITEMS}, p AS (
      SELECT *, max("end") OVER (PARTITION BY chr ORDER BY start, "end", strand, name, type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r WHERE {where}),
    i AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY chr ORDER BY start, "end", strand, name, type ROWS UNBOUNDED PRECEDING) AS island FROM p)
    SELECT chr, min(start) AS start, max("end") AS "end", first(strand ORDER BY start, "end", strand, name, type) AS strand,
      CASE WHEN count(*) > 1 THEN 'union' ELSE min(type) END AS type, first(name ORDER BY start, "end", strand, name, type) AS name, count(*) AS n_members
    FROM i GROUP BY chr, island {having}"""


query("region_union", _union_sql())(lambda s, d: regions.union(items(s, d)).drop("sequence"))
query("region_union_two", _union_sql("type IN ('A', 'N')"))(lambda s, d: regions.union(regions.of_type(items(s, d), "A"), regions.of_type(items(s, d), "N")).drop("sequence"))
query("region_union_where", _union_sql(having='HAVING max("end") - min(start) > 60'))(lambda s, d: regions.filter_length(regions.union(items(s, d)), ">", 60).drop("sequence"))
query("type_counts", f"WITH {ITEMS} SELECT type, count(*) AS n FROM r GROUP BY type")(lambda s, d: regions.type_counts(items(s, d)))
query("top20", f'WITH {ITEMS} SELECT {COLUMNS} FROM r ORDER BY chr, start, "end", name LIMIT 20')(lambda s, d: regions.top(items(s, d).select(*REGION), 20, "chr", "start", "end", "name"))

# --- windows


def _targets(seqs: DataFrame) -> DataFrame:
    return motif.as_regions(motif.find(seqs, NEAR, "+"), "p")


def _within_sql(direction: str, distance: int, name: str | None = None, hits: str = "") -> str:
    lo, hi = (f"greatest(t.position - {distance}, 0)", "t.position") if direction == "UPSTREAM" else ("t.position + 4", f"least(t.position + 4 + {distance}, t.n)")
    which = f"WHERE position = {name}" if name else ""
    return f"""WITH {DNA}, t AS (SELECT * FROM ({_literal(NEAR, '+', out=', length(seq) AS n')}) {which}),
    h AS ({hits or f"{_literal(MOTIF, '+')} UNION ALL {_literal(_rc(MOTIF), '-')}"})
    SELECT h.seq_id, h.position, h.match_length, h.strand FROM h JOIN t ON h.seq_id = t.seq_id AND h.position >= {lo} AND h.position + h.match_length <= {hi}"""


def _within(s: SparkSession, d: str, direction: str, distance: int, name: str | None = None) -> DataFrame:
    seqs = dna(s, d)
    targets = _targets(seqs) if name is None else within.named(_targets(seqs), name)
    return within.find_within(seqs, MOTIF, targets, distance, direction).select(*MATCH)


for _direction in ("UPSTREAM", "DOWNSTREAM"):
    query(f"within_{_direction.lower()}_bp", _within_sql(_direction, 50))(lambda s, d, w=_direction: _within(s, d, w, 50))
    query(f"within_{_direction.lower()}_kb", _within_sql(_direction, 1000))(lambda s, d, w=_direction: _within(s, d, w, 1000))
_regex_hits = f"{_places.format(pos='p', sign='+', source='d', regex=REGEX)} UNION ALL {_places.format(pos='length(seq) - p - 3', sign='-', source='rc', regex=REGEX)}"
query("within_regex", _within_sql("DOWNSTREAM", 100, hits=_regex_hits))(lambda s, d: within.find_within(dna(s, d), REGEX, _targets(dna(s, d)), 100, "DOWNSTREAM").select(*MATCH))
query("within_named", _within_sql("UPSTREAM", 200, "75"))(lambda s, d: _within(s, d, "UPSTREAM", 200, "p_75"))


# --- alignment and scripts


def _similar(s: SparkSession, d: str, op: str, value: float) -> DataFrame:
    seqs = dna(s, d)
    hits = motif.as_regions(motif.find(seqs, "GATTA", "+"), "h").select("chr", (F.col("start") - 20).alias("start"), (F.col("end") + 20).alias("end"), "strand", "type", "name", "sequence")
    cut = regions.attach_sequence(hits.where(F.col("start") >= 0), seqs).where(F.col("sequence") != "")
    found = filter_similarity(cut.withColumn("ord", F.struct("chr", "start")), op, value)
    return found.select("chr", "start", "end", "name")


def _similar_sql(passes: str) -> str:
    """Alignments by anti-diagonals: a cell is made from its neighbours of the two diagonals before, with the equal and
    all columns of its way back (a diagonal step before a gap in the target, that before one in the query)."""
    return f"""WITH RECURSIVE {DNA}, hits AS ({_literal('GATTA', '+', out=', seq')}),
    cut AS (
      SELECT seq_id AS chr, position - 20 AS start, position + 25 AS "end", 'h_' || position AS name, substr(seq, position - 19, 45) AS s
      FROM hits WHERE position >= 20 AND position + 25 <= length(seq)),
    first AS (SELECT chr AS c, start AS p, s AS q FROM cut ORDER BY chr, start LIMIT 1),
    targets AS (SELECT DISTINCT s, q FROM cut, first),
    cell AS (
      SELECT s, q, 0 AS d, i, 0 AS v, 0 AS same, 0 AS cols, 0 AS pv, 0 AS psame, 0 AS pcols FROM targets, range(0, 46) r(i)
      UNION ALL
      SELECT s, q, d, i, best, CASE WHEN best = 0 THEN 0 WHEN best = dg THEN dsame + eq WHEN best = up THEN usame ELSE same END,
        CASE WHEN best = 0 THEN 0 WHEN best = dg THEN dcols + 1 WHEN best = up THEN ucols + 1 ELSE cols + 1 END, v, same, cols
      FROM (
        SELECT *, CASE WHEN i < 1 OR d - i < 1 OR d - i > 45 THEN 0 ELSE greatest(0, dg, up, v - 2) END AS best FROM (
          SELECT s, q, d + 1 AS d, i, v, same, cols, CAST(substr(q, i, 1) = substr(s, d + 1 - i, 1) AS INTEGER) AS eq,
            lag(pv) OVER w + CASE WHEN substr(q, i, 1) = substr(s, d + 1 - i, 1) THEN 2 ELSE -1 END AS dg, lag(psame) OVER w AS dsame, lag(pcols) OVER w AS dcols,
            lag(v) OVER w - 2 AS up, lag(same) OVER w AS usame, lag(cols) OVER w AS ucols
          FROM cell WHERE d < 90 WINDOW w AS (PARTITION BY s ORDER BY i)))),
    scored AS (
      SELECT s, CASE WHEN b.cols > 0 THEN b.same / b.cols * 100 ELSE 0 END AS similarity
      FROM (SELECT s, max(struct_pack(v := v, i := -i, j := i - d, same := same, cols := cols)) AS b FROM cell GROUP BY s))
    SELECT chr, start, "end", name FROM cut JOIN scored USING (s), first WHERE chr = c AND start = p OR {passes}"""


for _name, _op, _value, _passes in (("ge", ">=", 75.0, "similarity >= 75"), ("lt", "<", 60.0, "similarity < 60"), ("eq", "=", 70.0, "abs(similarity - 70) <= 0.5")):
    query(f"similarity_{_name}", _similar_sql(_passes))(lambda s, d, op=_op, v=_value: _similar(s, d, op, v))


def script(s: SparkSession, d: str, text: str) -> DataFrame:
    session = Session(s, long_records=False)
    session.register_sequences("docs", dna(s, d))
    session.register_matrix("demo", SCORES)
    return session.run(text)[-1].frame


query("script_find_intersect", f"""WITH {DNA}, a AS ({_literal(MOTIF, '+')}), b AS ({_literal(_rc(NEAR), '-')})
  SELECT seq_id AS chr, position AS start, position + 4 AS "end", strand, 'x ∩ y' AS type, 'x_' || position AS name, '{MOTIF}' AS sequence FROM a
  WHERE EXISTS (SELECT 1 FROM b WHERE a.seq_id = b.seq_id AND a.position < b.position + 4 AND a.position + 4 > b.position)""")(
    lambda s, d: script(s, d, f'FIND MOTIF "{MOTIF}" STRAND POSITIVE AS x; FIND MOTIF "{NEAR}" STRAND NEGATIVE AS y; INTERSECT x AND y;').drop("ord"))
query("script_scan_except", f"""WITH {DNA}, a AS ({_scan_sql('+', 85)}), b AS ({_literal(MOTIF, '+')} UNION ALL {_literal(_rc(MOTIF), '-')})
  SELECT seq_id AS chr, position AS start, position + 6 AS "end", strand, 's' AS type, 's_' || position AS name FROM a
  WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.seq_id = b.seq_id AND a.position < b.position + 4 AND a.position + 6 > b.position)""")(
    lambda s, d: script(s, d, f'SCAN demo STRAND POSITIVE THRESHOLD 85% AS s; FIND MOTIF "{MOTIF}" AS m; EXCEPT s FROM m WHERE LENGTH > 0.002 KB;').select(*REGION))


# --- files: written from the driver's tables, then read by the sources


def scratch(s: SparkSession, name: str) -> str:
    """A fresh path in the folder that the cluster's machines share; on a local master without one, in a temporary folder."""
    folder = shared_folder(s)
    if folder is None:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def fasta_file(s: SparkSession, d: str) -> str:
    """Documents as records, in lines of 60 bases."""
    path = scratch(s, "fasta")
    docs = dna(s, d).join(s.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").cast("string").alias("seq_id"), "lang", "source"), "seq_id")
    lines = F.regexp_replace(F.lower("sequence"), "(.{60})", "$1\n")
    docs.select(F.concat(F.lit(">"), "seq_id", F.lit(" "), F.coalesce("lang", F.lit("")), F.lit(" of "), F.coalesce("source", F.lit("")), F.lit("\r\n"), lines)).write.text(path)
    return path


def gff3_file(s: SparkSession, d: str) -> str:
    """Line items as features; those of flag A are genes."""
    path = scratch(s, "gff3")
    rows = items(s, d, "A")
    attributes = F.concat(F.lit("ID=item;Parent=Name=no;Name="), "name", F.lit(";note=x"))
    cells = ["chr", F.lit("made"), "type", (F.col("start") + 1).cast("string"), F.col("end").cast("string"), F.lit("."), "strand", F.lit("."), attributes]
    rows.select(F.concat_ws("\t", *cells).alias("value")).union(s.createDataFrame([("# a comment",), ("",), ("broken\tline",)], "value string")).write.text(path)
    return path


def jaspar_file(s: SparkSession, d: str) -> str:
    """How often each base stands at each of the first six places of the documents."""
    path = scratch(s, "jaspar")
    seqs = dna(s, d).where(F.length("sequence") >= 6)
    counts = seqs.agg(*(F.sum((F.substring("sequence", j + 1, 1) == b).cast("long")).alias(f"{b}{j}") for b in BASES for j in range(6)))
    rows = [F.concat(F.lit(f"{b}  [ "), F.concat_ws(" ", *(F.col(f"{b}{j}").cast("string") for j in range(6))), F.lit(" ]")) for b in BASES]
    counts.select(F.concat_ws("\n", F.lit(">SL2 begin"), *rows)).coalesce(1).write.text(path)
    return path


query("fasta_scan", f"""WITH {DNA} SELECT seq_id, seq_id || ' ' || coalesce(lang, '') || ' of ' || coalesce(source, '') AS header, seq AS sequence
  FROM d JOIN documents ON seq_id = CAST(doc_id AS VARCHAR)""")(lambda s, d: read_fasta(s, fasta_file(s, d)).select("seq_id", "header", "sequence"))
_GFF = """f AS (SELECT chr, start, "end", strand, CASE type WHEN 'A' THEN 'gene' ELSE type END AS type, name FROM r WHERE start >= 0),
  p AS (SELECT chr, CASE strand WHEN '+' THEN greatest(start - 250, 0) ELSE "end" END AS start, CASE strand WHEN '+' THEN start ELSE "end" + 250 END AS "end", strand, 'promoter' AS type, name || '_promoter' AS name FROM f WHERE type = 'gene'),
  t AS (SELECT chr, CASE strand WHEN '+' THEN start ELSE "end" - 1 END AS start, CASE strand WHEN '+' THEN start + 1 ELSE "end" END AS "end", strand, 'TSS' AS type, name || '_TSS' AS name FROM f WHERE type = 'gene')"""
query("gff3_scan", f'WITH {ITEMS}, {_GFF} SELECT * FROM f UNION ALL SELECT * FROM p WHERE start < "end" UNION ALL SELECT * FROM t')(lambda s, d: read_gff3(s, gff3_file(s, d)).select(*REGION))
query("gff3_loose", f'WITH {ITEMS}, {_GFF} SELECT chr, start, "end", strand, type, \'no\' AS name FROM f')(lambda s, d: read_gff3(s, gff3_file(s, d), strict=False, derive=False).select(*REGION))


@query("jaspar_scan", f"""WITH {DNA}, l AS (SELECT CAST(pos AS INTEGER) AS pos, substr(seq, pos + 1, 1) AS base FROM d, range(0, 6) t(pos) WHERE length(seq) >= 6),
  c AS (SELECT pos, b.base, count(l.base) AS n FROM (SELECT unnest(range(0, 6)) AS pos) JOIN (VALUES ('A'), ('C'), ('G'), ('T')) b(base) ON true LEFT JOIN l USING (pos, base) GROUP BY pos, b.base),
  s AS (SELECT *, log2((n + 0.8e0) / (sum(n) OVER (PARTITION BY pos) + 3.2e0) / 0.25e0) AS score FROM c)
  SELECT 'begin' AS matrix, CAST(pos AS INTEGER) AS pos, base, n, CAST(round(score * 1000000) AS BIGINT) AS score_micro FROM s""")
def jaspar_scan(s: SparkSession, d: str) -> DataFrame:
    matrix = read_jaspar(s, jaspar_file(s, d))
    table = pssm(matrix)
    cells = [(table.name, j, b, int(matrix.counts[k][j]), table.scores[k][j]) for k, b in enumerate(BASES) for j in range(table.length)]
    return s.createDataFrame(cells, "matrix string, pos int, base string, n long, score double").select("matrix", "pos", "base", "n", F.round(F.col("score") * 1_000_000).cast("long").alias("score_micro"))


@query("bed_sink", f"""WITH {ITEMS} SELECT chr, start, "end", name, '0' AS score, strand FROM r""")
def bed_sink(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s, "bed")
    write_bed(items(s, d), path)
    cells = F.split("value", "\t")
    return s.read.text(path).select(cells[0].alias("chr"), cells[1].cast("long").alias("start"), cells[2].cast("long").alias("end"), cells[3].alias("name"), cells[4].alias("score"), cells[5].alias("strand"))


@query("scan_percent", f"WITH {DNA} SELECT seq_id, position, CAST(round((score - {SCORES.min_score!r}e0) / ({SCORES.max_score!r}e0 - {SCORES.min_score!r}e0) * 100 * 1000) AS BIGINT) AS percent_milli FROM ({_scan_sql('+', 80, ', ' + '{total} AS score')})")
def scan_percent(s: SparkSession, d: str) -> DataFrame:
    """Matches with their scores in percent of the range."""
    found = pwm.scan(dna(s, d), SCORES, "+", 80, scores=True)
    return found.select("seq_id", "position", F.round(percent_of(SCORES, F.col("score")) * 1000).cast("long").alias("percent_milli"))


@query("script_files", f"""WITH {DNA}, {ITEMS}, {_GFF}, a AS ({_literal(MOTIF, '+')}), b AS (SELECT * FROM f WHERE type = 'gene')
  SELECT seq_id AS chr, position AS start, position + 4 AS "end", strand, 'm ∩ gene' AS type, 'm_' || position AS name FROM a
  WHERE EXISTS (SELECT 1 FROM b WHERE b.chr = a.seq_id AND a.position < b."end" AND a.position + 4 > b.start)""")
def script_files(s: SparkSession, d: str) -> DataFrame:
    """A script that loads its files."""
    return Session(s).run(f'''// sequences and features from files
        LOAD SEQUENCE "{fasta_file(s, d)}" AS docs; LOAD ANNOTATION "{gff3_file(s, d)}" AS marks; LOAD MATRIX "{jaspar_file(s, d)}" AS start;
        FIND MOTIF "{MOTIF}" STRAND POSITIVE AS m; INTERSECT m AND GENE WHERE LENGTH >= 0.004 KB;''')[-1].frame.select(*REGION)


@query("result_sizes", f"""WITH {ITEMS} SELECT * FROM (SELECT 1 AS statement, count(*) AS n, count(*) > 0 AS shown FROM r WHERE "end" - start > 45
  UNION ALL SELECT 2, count(*), count(*) > 0 FROM r WHERE "end" - start > 5000)""")
def result_sizes(s: SparkSession, d: str) -> DataFrame:
    """The number of rows that a script's results print, and whether any are shown."""
    session = Session(s)
    session.register_regions("items", items(s, d).withColumn("ord", F.struct("chr", "start", "end", "name")))
    texts = [r.text() for r in session.run("EXTRACT items WHERE LENGTH > 45; EXTRACT items WHERE LENGTH > 5 KB;")]
    sizes = [int(m[1]) if (m := re.match(r"\s*Found (\d+) ", t)) else 0 for t in texts]
    return s.createDataFrame([(k, n, "[1]" in t) for k, (n, t) in enumerate(zip(sizes, texts, strict=True), 1)], "statement int, n long, shown boolean")


# --- the observed reading


def _observed(s: SparkSession, d: str, text: str, regions_too: bool = True) -> DataFrame:
    session = Session(s, "observed", long_records=False)
    if regions_too:
        session.register_regions("items", items(s, d).withColumn("ord", F.struct("chr", "start", "end", "name")))
    else:
        session.register_sequences("docs", dna(s, d).where("seq_id = '71'"))
        session.register_matrix("demo", SCORES)
    return session.run(text)[-1].frame


for _name, _where, _sql in (
    ("or", "LENGTH > 40 OR LENGTH < 45", "n > 40 AND n < 45"),
    ("not", "NOT LENGTH > 47", "n > 47"),
    ("units", "LENGTH > 0.049 KB AND LENGTH < 3.9 BP", "n > 0 AND n < 3"),
    ("string", 'LENGTH > "many"', "n > 0"),
):
    query(f"observed_{_name}", f'WITH {ITEMS} SELECT {COLUMNS} FROM (SELECT *, "end" - start AS n FROM r) WHERE {_sql}')(lambda s, d, w=_where: _observed(s, d, f"EXTRACT items WHERE {w};").select(*REGION))
# one record counts, a lower-case palindrome is found on both strands, threshold 0 means 75, and an alias names the set before WHERE
_ONE = "o AS (SELECT * FROM d WHERE seq_id = '71'), orc AS (SELECT seq_id, reverse(translate(seq, 'ACGT', 'TGCA')) AS seq FROM o)"
for _name, _text, _sql in (
    ("palindrome", f'FIND MOTIF "{PALINDROME.lower()}" AS m;', f"{_literal(PALINDROME, '+', 'o')} UNION ALL {_literal(PALINDROME, '-', 'o')}"),
    ("threshold", "SCAN demo STRAND NEGATIVE THRESHOLD 0% AS m;", _scan_sql("-", 75).replace("FROM rc", "FROM orc")),
    ("alias", f'FIND MOTIF "{MOTIF}" STRAND POSITIVE AS m WHERE LENGTH > 5; EXTRACT m;', _literal(MOTIF, "+", "o")),
):
    query(f"observed_{_name}", f'WITH {DNA}, {_ONE} SELECT position AS start, position + match_length AS "end", strand, \'m_\' || position AS name FROM ({_sql})')(
        lambda s, d, t=_text: _observed(s, d, t, False).select("start", "end", "strand", "name"))


def entry(spark: SparkSession, sf_dir: str = "/root/testdata/sf0.001") -> DataFrame:
    """Flagship: motifs of both strands near others, by a script."""
    return script(spark, sf_dir, f'FIND MOTIF "{MOTIF}" AS x; FIND MOTIF "{NEAR}" WITHIN 1 KB UPSTREAM FROM x AS y; INTERSECT y AND x;').drop("ord")
