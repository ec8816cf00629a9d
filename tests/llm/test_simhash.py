"""SimHash near-dedup, components and tiles against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from strandline.llm import simhash
from strandline.llm.components import components, tiles


def groups(n, pairs):
    up = {i: i for i in n}

    def find(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {i: find(i) for i in n}


def brute_fingerprint(text, words):
    w = [p for p in re.split(rb"[\x20\x09-\x0d]+", (text or "").encode()) if p]
    w = [bytes(c + 32 if 65 <= c <= 90 else c for c in p) for p in w]
    shingles = [b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(v >> k & 1 for v in h) > len(h))


def test_fingerprints_equal_definition():
    rng = random.Random(1)
    texts = [None, "", " \n\t", "One", "one TWO", "a b c", "É é\x0bx\x85y", "w " * 700] + [" ".join(rng.choice("the of And ß zwei x".split()) for _ in range(rng.randint(1, 400))) for _ in range(40)]
    for t in texts:
        for words in (3, 5):
            assert int(simhash.fingerprint(simhash.shingle_hashes(t or "", words))[0]) == brute_fingerprint(t, words)


@pytest.mark.parametrize("block", [7, 4096])
def test_links_find_all_pairs_within_budget(spark, block):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(60)]
    prints = set(base)
    for f in base:
        for _ in range(6):
            g = f
            for k in rng.sample(range(64), rng.randint(1, 3)):
                g ^= 1 << k
            prints.add(g)
    hot = base[0]
    prints |= {hot ^ (1 << a) ^ (1 << b) for a in range(0, 20) for b in range(40, 64)}  # one hot bucket
    prints |= {(7 << 42) | rng.getrandbits(42) for _ in range(150)}  # a hot segment without links
    prints = sorted(prints)
    ids = list(range(len(prints)))
    rng.shuffle(ids)
    df = spark.createDataFrame([(i, bytearray(p.to_bytes(8, "big"))) for i, p in zip(ids, prints, strict=True)], "id long, fp binary")
    got = [tuple(r) for r in simhash.link(df, 1, 2, 3, block=block).collect()]
    by = dict(zip(ids, prints, strict=True))
    want = [(a, b) for a in ids for b in ids if a < b and (by[a] ^ by[b]).bit_count() <= 2]
    assert groups(ids, got) == groups(ids, want)
    found = components(simhash.link(df, 1, 2, 3, block=block)).collect()
    want = groups(ids, want)
    assert all(want[r.id] == r.component for r in found) and len(found) == len({r.id for r in found})
    linked = {i for i in ids if sum(want[i] == c for c in want.values()) > 1}
    assert {r.id for r in found} == linked


def test_near_duplicates(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(500)]
    texts = [None, "", " \n", "one", "ONE", "one two", "x " * 9000]
    for _ in range(30):
        t = [rng.choice(words) for _ in range(rng.randint(3, 300))]
        texts += [" ".join(t), " ".join(t).upper().replace("W", "w")]
        t[rng.randrange(len(t))] = "edit"
        texts.append("\n".join(t))
    rows = [(1000 - k, t, "clash") for k, t in enumerate(texts)]
    rows += rows[:3]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    got = simhash.near_duplicates(df, words=3).collect()
    prints = {i: brute_fingerprint(t, 3) for i, t, _ in rows}
    want = groups(prints, [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2])
    assert len(got) == len(rows)
    assert all(r.fingerprint == f"{prints[r.doc_id]:016x}" and r.component_id == want[r.doc_id] for r in got)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_components_of_paths_and_stars(spark):
    pairs = [(k, k + 1) for k in range(100, 180)] + [(5, k) for k in range(200, 400)] + [(9, 9), (300, 301)]
    got = {r.id: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {k: v for k, v in groups(range(500), pairs).items() if any(k in p and p[0] != p[1] for p in pairs)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_tiles_let_each_pair_meet(spark):
    df = spark.range(200).select(F.when(F.col("id") < 150, 0).otherwise(F.col("id")).alias("k"), "id")
    rows = tiles(df, ["k"], "id", 20).collect()
    met = {}
    for r in rows:
        met.setdefault((r.k, r.tile), set()).add(r.id)
    assert max(map(len, met.values())) < 70
    assert all(any({a, b} <= v for (k, _), v in met.items() if k == 0) for a in range(150) for b in range(a))
    assert np.sum([len(v) for (k, _), v in met.items() if k]) == 50
