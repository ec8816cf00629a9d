"""Vector near-dedup and exact top-k search against brute force."""

import io
import math
from fractions import Fraction

import numpy as np
import pytest
from test_simhash import groups

from strandline.llm import topk, vector_dedup


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n_links string")


def brute(rows, least):
    links = {k: [] for k in range(len(rows))}
    ok = [k for k, (i, v, lab, _) in enumerate(rows) if i is not None and lab is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    unit = {k: np.array(rows[k][1], np.float32).astype(float) for k in ok}
    for a in ok:
        for b in ok:
            if a < b and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] / (np.linalg.norm(unit[a]) * np.linalg.norm(unit[b])) >= least:
                links[a].append(b)
                links[b].append(a)
    return links


@pytest.mark.parametrize("block", [16, 2048])
def test_vector_dedup(spark, block):
    rng = np.random.default_rng(0)
    rows = []
    for g in range(25):
        centre = rng.normal(size=32)
        for _ in range(rng.integers(1, 6)):
            rows.append((centre + rng.normal(size=32) * 0.13).tolist())
    hot = rng.normal(size=32)
    rows += [(hot + rng.normal(size=32) * rng.choice([0.02, 0.1])).tolist() for _ in range(90)]
    rows += [rows[0]] * 5 + [[x * 8 for x in rows[1]], [0.0] * 32, [1.0], [2.0], [1.0, 2.0, 3.0]]
    rows = [(k, v, k % 2 if k > 20 else 0, "clash") for k, v in enumerate(rows)]
    rows += [(9000, None, 1, ""), (9001, [], 1, ""), (9002, [None, 1.0], 1, ""), (9003, [float("nan"), 1.0], 1, ""), (9004, [float("inf")], 1, ""), (9005, rows[0][1], None, ""), (None, rows[0][1], 0, "")]
    got = vector_dedup.near_duplicates(table(spark, rows), block=block, tables=8, probes=2).collect()
    want = brute(rows, 0.98)
    assert len(got) == len(rows)
    ids = [r[0] for r in rows]
    comp = groups([i for i in ids if i is not None], [(ids[a], ids[b]) for a, v in want.items() for b in v])
    n_links = {i: len(v) for i, v in zip(ids, want.values(), strict=True)}
    by = {r.vec_id: r for r in got}
    total, found = sum(n_links.values()), sum(r.n_links for r in got)
    assert found >= 0.99 * total and all(by[i].n_links <= n for i, n in n_links.items())
    if found == total:
        assert all(by[i].component_id == c for i, c in comp.items())
    assert all(by[i].n_links == 0 and by[i].component_id == i and by[i].kept for i in range(9000, 9006))
    assert by[None].n_links == 0 and by[None].component_id is None
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert vector_dedup.near_duplicates(table(spark, rows).limit(0)).count() == 0


def test_recall_on_the_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label, None) for r in df.collect()]
    vec = np.array([r[1] for r in rows], float)
    unit, label = vec / np.linalg.norm(vec, axis=1, keepdims=True), np.array([r[2] for r in rows])
    near = (unit @ unit.T >= 0.98) & (label[:, None] == label[None, :])
    want = near.sum(axis=1) - 1
    got = {r.vec_id: r.n_links for r in vector_dedup.near_duplicates(df).collect()}
    found = sum(got.values())
    assert found >= 0.9 * want.sum() and all(got[r[0]] <= n for r, n in zip(rows, want.tolist(), strict=True))


def top(rows, k, every):
    ok = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int)) for i, v, *_ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in ok:
        if i % every == 0:
            best = sorted((-int(q @ v), j) for j, v in ok if j != i and len(v) == len(q))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize(("tree_rows", "query_rows"), [(40, 3), (16_384, 2048)])
def test_topk(spark, tree_rows, query_rows):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(8, 12)) * 5
    rows = [(k, (centres[rng.integers(8)] + rng.normal(size=12) * 0.2).tolist()) for k in range(600)]
    rows += [(700 + k, rows[3][1]) for k in range(9)] + [(k, [0.0] * 12) for k in (800, 801)] + [rows[50]] * 2 + [(-50, rows[7][1])]
    rows += [(900, None), (950, []), (1000, [None] * 12), (1050, [float("inf")] * 12), (1100, [1.0, 2.0]), (1101, [3.0, -1.0]), (None, rows[1][1])]
    df = spark.createDataFrame([(i, v, 0, "clash") for i, v in rows], "vec_id long, embedding array<float>, label int, score string").repartition(3)
    got = sorted(tuple(r) for r in topk.search(df, k=5, every=50, tree_rows=tree_rows, query_rows=query_rows).collect())
    assert got == top(rows, 5, 50)
    assert topk.search(df.limit(0)).count() == 0


def test_trees_skip_distances_and_pages():
    rng = np.random.default_rng(1)
    v = (rng.normal(size=(40, 16))[rng.integers(0, 40, 4000)] * 400 + rng.normal(size=(4000, 16)) * 9).astype(int)
    want = v[:50] @ v.T
    best = [sorted((-int(s), j) for j, s in enumerate(w.tolist()) if j != q)[:5] for q, w in enumerate(want)]
    known = [-b[-1][0] for b in best]
    counts = []
    for least in (None, known):
        tree = topk.Tree(io.BytesIO(topk.dump(np.arange(4000), v, leaf=64, fan=8)))
        computed = []
        real = topk.exact
        try:
            topk.exact = lambda a, b: computed.append(len(a) * len(b)) or real(a, b)
            assert tree.search(np.arange(50), v[:50], 5, least) == best
        finally:
            topk.exact = real
        counts.append(sum(computed))
    assert counts[1] <= counts[0] < 0.5 * 50 * 4000
    one = topk.Tree(io.BytesIO(topk.dump(np.arange(4000), v, leaf=64, fan=8)))
    assert one.search(np.array([7]), v[7:8], 5)[0] == best[7]
    assert len(one.pages) < 0.3 * sum(len(c) == 0 for c in one.children)


def test_topk_of_wide_components(spark):
    rows = [(k, [float(x) for x in v]) for k, v in enumerate([(1e6, 2.5, -3.0), (1e6, 2.25, -3.0), (9e15, 1.0, 0.5), (-9e15, 1.0, 0.5), (1e300, 1.7e308, 0.0), (1e300, 1.6e308, -1.0), (0.0, 0.0, 0.0), (4e9, 4e9, 4e9), (4e9, 4e9, 4e9 + 1)])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)
    got = sorted(tuple(r) for r in topk.search(df, k=3, every=1, tree_rows=4, query_rows=2).collect())
    ints = [[int(Fraction(x) * 256 // 1) for x in v] for _, v in rows]
    want = []
    for q, a in enumerate(ints):
        scores = [(-max(min(sum(x * y for x, y in zip(a, b, strict=True)), 2**63 - 1), -(2**63)), j) for j, b in enumerate(ints) if j != q]
        want += [(q, r + 1, j, -s) for r, (s, j) in enumerate(sorted(scores)[:3])]
    assert got == sorted(want)
