"""The pipeline's stages against plain Python on a small corpus."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_simhash import groups

from strandline.llm import simhash

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(900)]

    def prose(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    def text(words):
        return "\n".join(" ".join(words[k : k + 12]) for k in range(0, len(words), 12))

    docs, kind = [], {}

    def add(t, what):
        kind[len(docs)] = what
        docs.append((len(docs), t, "en", "s", len(t or "")))

    for k in range(120):
        add(text(prose(rng.randint(40, 400))), "clean")
        if k % 3 == 0:
            add(" ".join(w.upper() + "!!" for w in prose(60)), "junk")
        if k % 4 == 0:
            add(docs[-1][1], "again")
    for k in range(20):  # near copies of one line each, so that line dedup leaves them whole
        words = prose(300)
        add(" ".join(words), "clean")
        for _ in range(2):
            w = list(words)
            w[rng.randrange(300)] = "changed"
            add(" ".join(w), "near")
    add(None, "empty")
    add("", "empty")
    labels = [(i, 0 if "!!" in (t or "") else 1, 0) for i, t, *_ in docs if i % 2]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, docs, kind


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_stages(spark, corpus):
    folder, docs, kind = corpus
    df = spark.read.parquet(f"{folder}/documents.parquet")
    good = stage("quality")(spark, df, folder)
    assert good.columns == df.columns
    ids = {r.doc_id for r in good.select("doc_id").collect()}
    text = dict((i, t) for i, t, *_ in docs)
    assert ids == {i for i in kind if "!!" not in (text[i] or "")}

    lines = stage("line_dedup")(spark, good, folder)
    assert lines.columns == df.columns
    left = {r.doc_id: r for r in lines.collect()}
    seen, want = set(), {}
    for i in sorted(ids):  # no two lines here are near but not equal, apart from those of near copies, which differ by more
        if text[i] is None:
            want[i] = None
            continue
        stay = [x for x in text[i].split("\n") if not x or x not in seen]
        seen |= set(text[i].split("\n"))
        if any(stay) or not text[i]:
            want[i] = "\n".join(stay)
    assert {i: r.text for i, r in left.items()} == want
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in left.values())

    near = stage("near_dedup")(spark, lines, folder)
    assert near.columns == df.columns
    kept = {r.doc_id for r in near.select("doc_id").collect()}
    near_ids = {i for i in left if kind[i] == "near"}
    assert not kept & near_ids
    assert kept == {i for i in left if i not in near_ids} - {max(i for i in left if kind[i] == "empty")}

    again = near.unionByName(near.limit(3))
    assert stage("near_dedup")(spark, again, folder).count() == len(kept)

    packed = stage("packing")(spark, near, folder)
    assert packed.select("doc_id").distinct().count() == len(kept)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 1024
    assert corpus_pipeline.run(spark, folder).count() == packed.count()


def test_empty_table(spark, corpus):
    folder, *_ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, folder)
    assert docs.count() == 0


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def altered(rng, words, least, most):
    """``words`` with words exchanged until the similarity is between ``least`` and ``most``."""
    w = list(words)
    while jaccard(shingles(" ".join(words)), shingles(" ".join(w))) > most:
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**9)}"
    assert jaccard(shingles(" ".join(words)), shingles(" ".join(w))) >= least
    return w


def test_near_dedup_links_by_similarity(spark):
    rng, texts = random.Random(5), []
    for k in range(120):
        words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
        low = (0.68, 0.72, 0.76, 0.82, 0.86, 0.9)[k % 6]
        texts += [" ".join(words), " ".join(altered(rng, words, low, low + 0.03))]
    page = [f"p{k}" for k in range(400)]
    texts += [" ".join(altered(rng, page, 0.82, 0.85)) for _ in range(40)]  # pages of a template, about 0.7 to each other
    texts += ["loop the loop " * 300 + " ".join(f"{k}x{i}" for i in range(60)) for k in range(2)]  # repeats outweigh what differs
    sets = [shingles(t) for t in texts]
    near = [(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if jaccard(sets[a], sets[b]) >= 0.8]
    up = groups(range(len(texts)), near)
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    kept = {r.doc_id for r in stage("near_dedup")(spark, df, "").select("doc_id").collect()}
    want = {i for i in up if up[i] == i}
    assert want <= kept  # nothing below the threshold goes
    pairs = [k for k in range(0, 240, 2) if (k, k + 1) in near]
    assert len(pairs) == 60 and sum(k + 1 not in kept for k in pairs) >= 0.9 * len(pairs)


@pytest.mark.parametrize("block", [3, 1024])
def test_verified_links_equal_brute_force(spark, block):
    rng, rows = random.Random(3), []
    for g in range(6):
        base = rng.sample(range(1000), 40)
        for _ in range(15):
            s = sorted({rng.randrange(1000) if rng.random() < 0.06 else x for x in base})
            rows.append((g, len(rows), len(rows) * 7919, np.array(s, np.uint64).tobytes()))
    rows += [(9, len(rows) + k, k, b"") for k in range(2)]
    sets = {i: set(np.frombuffer(s, np.uint64).tolist()) for _, i, _, s in rows}
    group = {i: g for g, i, *_ in rows}
    near = [(a, b) for a in sets for b in sets if a < b and group[a] == group[b] and (not sets[a] | sets[b] or jaccard(sets[a], sets[b]) >= 0.8)]
    df = spark.createDataFrame(rows, "group long, id long, sh long, shingles binary").repartition(3)
    got = [(r.a, r.b) for r in simhash.verified(df, 0.8, block).collect()]
    assert {tuple(sorted(p)) for p in got} <= set(near) and groups(sets, got) == groups(sets, near)
