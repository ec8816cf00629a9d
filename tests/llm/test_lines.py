"""Line dedup against brute force."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F
from test_simhash import groups

from strandline.llm import line_dedup


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, text, n):
    out = list(text)
    for _ in range(n):
        p = rng.randrange(len(out))
        match rng.randrange(3):
            case 0:
                del out[p]
            case 1:
                out.insert(p, rng.choice("abx"))
            case 2:
                out[p] = rng.choice("aby")
    return "".join(out)


@pytest.mark.parametrize("most", [0, 1, 2, 3])
def test_edit_distance(spark, most):
    rng, rows = random.Random(most), []
    for _ in range(400):
        a = "".join(rng.choice("abé😀") for _ in range(rng.randint(8, 40)))
        rows.append((a, edited(rng, a, rng.randint(0, most + 2)) + "ab"[: rng.randint(0, 2)]))
    rows = [r for r in rows if min(map(len, r)) > 2 * most]
    df = spark.createDataFrame(rows, "a string, b string")
    for r in df.withColumn("distance", line_dedup.edit_distance(F.col("a"), F.col("b"), most)).collect():
        want = distance(r.a, r.b)
        assert r.distance == want if want <= most else r.distance > most


@pytest.mark.parametrize(("most", "bound"), [(2, 400_000), (2, 0), (1, 400_000), (0, 400_000)])
def test_line_dedup(spark, most, bound, monkeypatch):
    monkeypatch.setattr(line_dedup, "BROADCAST", bound)
    rng = random.Random(7)
    base = ["".join(rng.choice("abcd efg") for _ in range(rng.randint(3, 45))) for _ in range(40)]
    pool = base + [edited(rng, b, rng.randint(1, 3)) for b in base if len(b) > 6 for _ in range(3)]
    texts = [None, "", "\n\n", "short one\nshort one\n\n }", "short one\n }\nshort two", base[0], "x" * 70_000, "x" * 69_999 + "y"] + ["\n".join(rng.choice(pool) for _ in range(rng.randint(1, 12))) for _ in range(40)]
    rows = [(k, t, "clash", "en", "x", 1.0) for k, t in enumerate(texts)] + [(9, texts[9], "clash", "en", "x", 2.0), (8, texts[11], "clash", "en", "x", 1.0), (None, texts[12], "clash", "en", "x", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_kept string, id string, th string, stay double").repartition(3)
    assert line_dedup.dedup(df, most=most).columns == ["doc_id", "text", "id", "th", "stay", "n_lines", "n_kept"]
    got = sorted(((r.doc_id is not None, r.doc_id, r.text or "", r.text is None, r.n_lines, r.n_kept) for r in line_dedup.dedup(df, most=most).collect()), key=str)
    hashes = {r.text: r.h for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    seen = {}  # line: its first place
    for i, t, *_ in rows:
        for p, line in enumerate((t or "").split("\n") if t is not None else []):
            if line:
                place = (i is not None, i or 0, hashes[t], p)
                seen[line] = min(seen.get(line, place), place)
    lines = sorted(seen)
    near = [(a, b) for k, a in enumerate(lines) for b in lines[k + 1 :] if min(len(a), len(b)) >= line_dedup.SHORTEST and abs(len(a) - len(b)) <= most and (most and max(len(a), len(b)) < 1000 and distance(a, b) <= most or most and len(a) > 1000)]
    group = groups(lines, near)
    first = {}
    for line, place in seen.items():
        first[group[line]] = min(first.get(group[line], place), place)
    want, done = [], set()
    for i, t, *_ in rows:
        if t is None:
            want.append((i is not None, i, "", True, 0, 0))
            continue
        again = (i, t) in done
        done.add((i, t))
        stay = [line for p, line in enumerate(t.split("\n")) if not line or not again and first[group[line]] == (i is not None, i or 0, hashes[t], p)]
        want.append((i is not None, i, "\n".join(stay), False, len(t.split("\n")), len(stay)))
    assert got == sorted(want, key=str)
    assert line_dedup.dedup(df.limit(0)).count() == 0


@pytest.mark.parametrize(("cold", "block"), [(16, 128), (2, 40)])
def test_dense_buckets_equal_brute_force(spark, cold, block, monkeypatch):
    """Thousands of lines with an equal segment: a cluster of near ones, many small clusters, and lines far from all others."""
    monkeypatch.setattr(line_dedup, "COLD", cold)
    monkeypatch.setattr(line_dedup, "BLOCK", block)
    rng = random.Random(cold)

    def line():
        return "".join(rng.choice("abcdef") for _ in range(14)) + "common middle" + "".join(rng.choice("abcdef") for _ in range(14))

    dense, lines = line(), set()
    while len(lines) < 1200:
        lines.add(edited(rng, dense, rng.randint(1, 2)))
    for _ in range(300):
        base = line()
        lines |= {base} | {edited(rng, base, rng.randint(1, 3)) for _ in range(rng.randint(0, 3))}
    far = [line() for _ in range(2)]
    lines |= {far[0], edited(rng, far[0], 2)}
    lines = sorted(lines)
    con = duckdb.connect()
    con.execute("CREATE TABLE t AS SELECT * FROM (SELECT unnest(?) AS line, unnest(?) AS k)", [lines, list(range(len(lines)))])
    near = con.execute("SELECT a.k, b.k FROM t a JOIN t b ON a.k < b.k WHERE levenshtein(a.line, b.line) <= 2").fetchall()
    group = groups(range(len(lines)), near)
    df = spark.createDataFrame([(k, t) for k, t in enumerate(lines)], "doc_id long, text string").repartition(3)
    kept = {r.doc_id for r in line_dedup.dedup(df).where("n_kept = 1").collect()}
    assert kept == set(group.values()) and len(kept) < len(lines) - 1200
