"""URL filters, licence scans and the quality classifier on small tables."""

import itertools
import random
import re
import textwrap
import zlib

import numpy as np
import pyarrow as pa
import pytest

from strandline.llm import license_scan, quality, url_filter

URLS = [None, "", "no scheme", "http://", "https://EN.Example.COM/en/71?q", "http://a.b.example.com/en/7", "ftp://com/en/", "http://com/en/x#y", "http://example.com?x=/en/7", "http://x.net/de/8", "http://example.net/de/8", "http://www.example.net/de/9", "http://badexample.net/de/8", "http://.org/es/1", "http://a..org/es/", "x://y://org/es/", "http://ÄÖ.org/es/é\n/z", "http://" + "a." * 3000 + "org/es/" + "p" * 5000, "http://b.org/fr/"]


def judged(url, rules, default="allow"):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(str.maketrans(url_filter.UPPER, url_filter.LOWER)), m[2]) if m else ("", "")
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, default)))


@pytest.mark.parametrize("few", [0, 2, 64])
def test_url_filter(spark, few):
    rules = url_filter.RULES + [("example.com", "", "block"), ("b.example.com", "/en", "allow"), ("example.com", "/en/", "allow"), ("example.com", "/en/", "block"), ("net", "/de/8x", "block")]
    urls = URLS + URLS[4:7] * 3
    pages = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(urls)], "page_id long, url string, rule string")
    table = spark.createDataFrame([*rules, (None, None, None)], "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, table, few=few).collect()}
    unique = {(h, p): v for h, p, v in sorted(rules)}  # block sorts last
    assert got == {k: judged(u, [(h, p, v) for (h, p), v in unique.items()]) for k, u in enumerate(urls)}
    assert url_filter.judge(pages.limit(0), table).count() == 0
    empty = url_filter.judge(pages, table.limit(0)).select("rule", "verdict").distinct().collect()
    assert [tuple(r) for r in empty] == [(None, "allow")]


@pytest.mark.parametrize("few", [1, 64])
def test_url_filter_equals_brute_force(spark, few):
    """Nested hosts and paths over many ranges; letters that sort before and after the full stop; a common host."""
    rng = random.Random(few)
    label = ["a", "a-b", "aa", "b", "", "A", "ä", "a_"]

    def host():
        return ".".join(rng.choice(label) for _ in range(rng.randint(1, 4)))

    def path():
        return "".join(rng.choice(["/", "x", "xy", "%"]) for _ in range(rng.randint(0, 4)))

    rules = list({(host().replace("A", "a"), path()): rng.choice(["allow", "block"]) for _ in range(150)}.items())
    urls = [f"s://{host()}{'/' + path() if rng.random() < 0.8 else ''}{rng.choice(['', '?q/x', '#f'])}" for _ in range(900)] + [f"s://a.b/{path()}" for _ in range(300)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3)
    table = spark.createDataFrame([(h, p, v) for (h, p), v in rules], "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, table, few=few).collect()}
    assert got == {k: judged(u, [(h, p, v) for (h, p), v in rules]) for k, u in enumerate(urls)}
    assert {r.verdict for r in url_filter.judge(pages, table.limit(0)).collect()} == {"allow"}


def license_matches(text, templates, texts, least):
    """(line, (dice, name)) by the definition, without any pruning."""
    lines = [(i, w) for i, x in enumerate(text.split("\n")) if (w := re.findall("[a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), x)))]

    def dice(a, b):
        a, b = set(a), set(b)
        return 2 * len(a & b) / (len(a) + len(b)) if a and b else 0

    def pairs(words):
        return [f"{a} {b}" for a, b in itertools.pairwise(words)]

    found = []
    for name, t in templates:
        found += [(i, (dice(pairs(w), license_scan.bigrams(t)), name)) for i, w in lines]
    for name, t in [*templates, *texts]:
        grams, runs = set(license_scan.bigrams(t)), [[]]
        for k, (i, w) in enumerate(lines):
            p = pairs((lines[k - 1][1][-1:] if k else []) + w + (lines[k + 1][1][:1] if k + 1 < len(lines) else []))
            if p and 2 * sum(g in grams for g in p) >= len(p):
                runs[-1].append((i, w))
            else:
                runs.append([])
        for run in runs:
            score = dice(pairs([x for _, w in run for x in w]), grams)
            found += [(i, (score, name)) for i, _ in run]
    best = {}
    for i, m in found:
        if m[0] >= least:
            best[i] = max(m, best.get(i, m))
    return sorted(best.items())


def test_license_scan(spark):
    rng = random.Random(2)
    texts = [None, "", "\n\n", "RELEASED under the (MIT) License!", "x\nAll  rights\treserved\nReleased under the MIT License.\nAll rights reserved. Yes", "Licensed under the Apache License Version 3.0", "mit " * 20_000, "all rights " * 3, "é" * 9, "word", "by cc by nc 4 0\ncc by nc 4 0 by", "\u0130nc 4\n\u212anc\nRELEASED UNDER THE M\u0130T LICENSE"]
    every = [t for _, t in license_scan.TEMPLATES + license_scan.TEXTS]
    for k in range(250):  # wrapped, indented and altered licences between other lines
        words = rng.choice(every).split()
        if k % 3:
            words = [w if rng.random() > 0.06 * (k % 3) else rng.choice(["any", "some", "the"]) for w in words]
        mark = rng.choice(["", "# ", " * ", "// "])
        wrapped = [mark + x for x in textwrap.wrap(" ".join(words), rng.choice([25, 60, 80, 10_000]))]
        more = [rng.choice(["", "of the software and", "This notice may go", "free of charge"]) for _ in range(rng.randint(0, 3))]
        texts.append("\n".join([*more, *wrapped, *more, *wrapped[: rng.randint(0, 3)]]))
    texts.append("\n".join(textwrap.wrap(every[-1], 60) * 200))
    docs = spark.createDataFrame([(k, t, 5, "x", "y") for k, t in enumerate([*texts, texts[4]])], "doc_id long, text string, n_lines int, lines string, matches string")
    got = {r.doc_id: r for r in license_scan.scan(docs, spans=True).collect()}
    some = 0
    for k, t in enumerate([*texts, texts[4]]):
        want = license_matches(t or "", license_scan.TEMPLATES, license_scan.TEXTS, license_scan.LEAST)
        some += len(want) > 3
        assert [(m.line, (m.best.dice, m.best.name)) for m in got[k].matches] == want
        assert (got[k].n_lines, got[k].n_license_lines, got[k].licenses) == ((t or "").count("\n") + 1, len(want), ",".join(sorted({n for _, (_, n) in want})))
        assert got[k].best_dice == max((d for _, (d, _) in want), default=None)
    assert some > 50
    assert license_scan.scan(docs.limit(0)).count() == 0
    assert license_scan.scan(docs, [], texts=[]).agg({"n_license_lines": "max"}).first()[0] == 0


def test_wrapped_licenses(spark):
    """Whole licences and headers, wrapped, commented or in one line, are found whole."""
    forms = [("\n".join(textwrap.wrap(t, 80)), name) for name, t in license_scan.TEXTS]
    forms += [("\n".join(f" * {x}" for x in textwrap.wrap(t, 60)), name) for name, t in license_scan.TEXTS]
    forms += [(t, name) for name, t in license_scan.TEXTS]
    forms += [("\n".join(textwrap.wrap(t, 30)), name) for name, t in license_scan.TEMPLATES if len(t) > 40]
    docs = [(k, f"Some words of a text before.\n\n{t}\n\nAnd a few more after it.") for k, (t, _) in enumerate(forms)]
    docs += [(900, "Nothing of the kind\nin these lines"), (901, "The terms of the licence are\nfree of charge to any person")]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for k, (t, name) in enumerate(forms):
        assert name in got[k].licenses.split(",") and got[k].best_dice >= 0.9 and got[k].n_license_lines >= 0.9 * (t.count("\n") + 1), (name, got[k])
    assert got[900].n_license_lines == got[901].n_license_lines == 0


def test_anchors_are_needed():
    made = [license_scan.bigrams(t) for _, t in license_scan.TEMPLATES + license_scan.TEXTS]
    chosen = set(license_scan.anchors(made))
    for grams in made:
        bare = [g for g in grams if not set(g.split()) & chosen]
        assert 2 * len(bare) / (len(bare) + len(grams)) < license_scan.LEAST


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    first = np.array([1, 0, 0, 0, 1, 1, 0, 0], bool)
    up, move = rng.normal(size=8), rng.normal(size=(2, 2))
    good, pairs = quality.marginals(up, move, first, pairs=True)
    want, seen = np.zeros(8), np.zeros((2, 2))
    for a, z in ((0, 4), (4, 5), (5, 8)):
        weight = {path: np.exp(sum((2 * q - 1) * up[a + i] / 2 for i, q in enumerate(path)) + sum(move[p, q] for p, q in itertools.pairwise(path))) for path in itertools.product((0, 1), repeat=z - a)}
        for path, w in weight.items():
            w /= sum(weight.values())
            want[a:z] += w * np.array(path)
            for p, q in itertools.pairwise(path):
                seen[p, q] += w
    assert np.allclose(good, want) and np.allclose(pairs, seen)


def test_lines_and_features():
    batch = pa.RecordBatch.from_arrays([pa.array(["skipped", "a\n\nb c", None, "", "x\n"]).slice(1)], ["t"])
    data, starts, ends, row = quality.lines_of(batch, 0)
    assert [bytes(data[a:b]) for a, b in zip(starts, ends, strict=True)] == [b"a", b"", b"b c", b"", b"", b"x", b""]
    assert row.tolist() == [0, 0, 0, 1, 2, 3, 3]
    batch = pa.RecordBatch.from_arrays([pa.array(["to to to be\nto to to be\n  A! | 9 "])], ["t"])
    data, starts, ends, row = quality.lines_of(batch, 0)
    x = quality.line_features(data, starts, ends, np.array([True, False, False]))
    lag = 3 + quality.CLASSES
    assert np.allclose(x[:, lag], [0.5, 0.5, 0]) and np.allclose(x[:, lag + 1], [0.25, 0.25, 0])
    assert x[:, -2].tolist() == [0, 1, 0] and np.allclose(x[2, 3:lag] * 9, [1, 0, 1, 5, 0, 1, 1, 0, 0])


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(docs, labels)
    rows = quality.score(docs, model, keep=["doc_id"]).where(quality.held_out()).join(labels, "doc_id").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    assert len(rows) > 40 and np.mean([(r.score >= 0.3) == (r.quality == 1) for r in rows]) >= 0.95


def test_quality_odd_rows(spark):
    texts = [None, "", "\n\n", "a fine line\nand one more", "!!! ### $$$ " * 9, "word " * 40_000, "\n" * 30_000]
    docs = spark.createDataFrame([(k, t, 0.0, 1) for k, t in enumerate([*texts, texts[3]])] + [(None, "x", 0.0, 1)], "doc_id long, text string, score double, quality int")
    labels = spark.createDataFrame([(k, k % 2) for k in range(8)] * 2 + [(3, None), (None, 1)], "doc_id long, quality int")
    for known in (labels, labels.limit(0), labels.where("quality = 1")):
        model = quality.fit(docs, known)
        rows = quality.score(docs, model, lines=True).collect()
        assert len(rows) == len(texts) + 2 and all(0 <= r.score <= 1 for r in rows)
        by = {r.doc_id: r for r in rows}
        assert [len(by[k].good) for k in (0, 1, 2, 6)] == [1, 1, 3, 30_001]
        assert by[3].score == by[7].score
    assert quality.score(docs.limit(0), model).count() == 0


def test_document_scores_equal_plain_forward_backward(spark):
    """Scores by a line after line in logarithms, from the model's weights; a text's tail counts as much as its head."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(docs, labels)
    sample = [r.text for r in docs.where("doc_id < 40").collect()] + ["a line of words\n" * 300 + "!!! $$$ ### " * 500, "x\n\n| 9 | 9 |"]
    got = {r.k: r for r in quality.score(spark.createDataFrame(list(enumerate(sample)), "k int, text string"), model, lines=True).collect()}
    for k, t in enumerate(sample):
        lines = (t or "").encode().split(b"\n")
        ends = np.cumsum([len(x) + 1 for x in lines]) - 1
        x = quality.line_features(np.frombuffer((t or "").encode(), np.uint8), ends - [len(x) for x in lines], ends, np.arange(len(lines)) == 0)
        z = (x - model.mean) / model.scale
        pad = np.zeros((1, z.shape[1]))
        edge = np.arange(len(z))
        full = np.hstack([z, np.vstack([pad, z[:-1]]), np.vstack([z[1:], pad]), (edge == 0)[:, None], (edge == len(z) - 1)[:, None], np.ones((len(z), 1))])
        up = np.clip(full @ model.weight, -30, 30)
        own = np.stack([-up / 2, up / 2], axis=1)
        alpha, beta = [own[0]], [np.zeros(2)]
        for i in range(1, len(z)):
            alpha.append(own[i] + np.logaddexp.reduce(alpha[-1][:, None] + model.move, axis=0))
        for i in range(len(z) - 1, 0, -1):
            beta.append(np.logaddexp.reduce(model.move + (own[i] + beta[-1])[None, :], axis=1))
        both = np.array(alpha) + np.array(beta[::-1])
        good = np.exp(both[:, 1] - np.logaddexp(both[:, 0], both[:, 1]))
        assert np.allclose(good, got[k].good, atol=1e-6)
        size = np.array([len(x) for x in lines]) + 1e-3
        share = np.clip((good * size).sum() / size.sum(), 1e-4, 1 - 1e-4)
        assert abs(got[k].score - 1 / (1 + np.exp(-np.clip(model.slope * np.log(share / (1 - share)) + model.shift, -30, 30)))) < 1e-5


def test_training_reads_whole_texts(spark):
    """Documents of 200 lines that differ in their last lines alone."""
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    docs = []
    for k in range(120):
        head = [" ".join(word() for _ in range(6)) for _ in range(150)]
        tail = [("!!! $$ 99 " * 12 if k % 2 else " ".join(word() for _ in range(20))) for _ in range(60)]
        docs.append((k, "\n".join(head + tail)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    model = quality.fit(df, spark.createDataFrame([(k, 1 - k % 2) for k, _ in docs], "doc_id long, quality int"))
    rows = quality.score(df, model).where(quality.held_out()).collect()
    assert len(rows) > 10 and all((r.score >= 0.3) == (r.doc_id % 2 == 0) for r in rows)


def test_sample_bounds(spark):
    docs = spark.createDataFrame([(k, f"{'good' if k % 2 else '!!'} line\n" * 10) for k in range(60)] + [(3, "again")] * 50, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    for bounds in ({"most_docs": 5}, {"most_lines": 35}, {"most_chars": 200}, {"most_lines": 1}):
        assert np.isfinite(quality.fit(docs, labels, **bounds).weight).all()
