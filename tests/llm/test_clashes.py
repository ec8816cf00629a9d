"""Columns of every name that the operators and stages use inside go through them, or are left aside."""

import pytest

from strandline.llm import bpe, license_scan, line_dedup, packing, quality, simhash, token_files, topk, url_filter, vector_dedup

corpus_pipeline = pytest.importorskip("corpus_pipeline")
public_tokenizers = pytest.importorskip("public_tokenizers")
NAMES = [
    "id", "th", "pos", "h", "h2", "key", "node", "stay", "_stay", "kept", "rest", "row", "turn", "first", "n", "_id", "copy_id", "copy", "score", "good", "text_", "_text", "n_kept", "n_lines", "lines", "found", "matches",
    "lower", "words", "able", "held", "host", "path", "rule", "verdict", "slice", "stack", "label_", "v", "width", "tile", "own", "task", "rank", "piece", "start", "length", "offset", "sequence_id", "component", "component_id", "fp", "group", "c0", "c1",
]
TEXTS = [None, "", "a line of sixteen letters\nand one more line here\nRELEASED under the MIT License.", "a line of sixteen letters\nother text altogether", "!!! $$ 9 " * 9, "a line of sixteen letters\nother text altogether"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, *["x"] * len(NAMES)) for k, t in enumerate(TEXTS)] + [(5, TEXTS[5], *["x"] * len(NAMES))]
    return spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", *(f"`{c}` string" for c in NAMES)]))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("operator", [
    lambda d: license_scan.scan(d),
    lambda d: bpe.encode_table(d, public_tokenizers.path("word_bpe_49k.json")),
    lambda d: packing.pack(d, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "piece", "start", "length", "ids_crc32"),
    lambda d: simhash.near_duplicates(d, words=3),
    lambda d: simhash.similar_documents(d, 0.8),
    lambda d: token_files.write_and_read(d, public_tokenizers.path("byte_bpe_50k.json")),
])
def test_results_do_not_depend_on_further_columns(docs, operator):
    assert rows(operator(docs)) == rows(operator(docs.select("doc_id", "text")))


def test_columns_are_kept(spark, docs):
    done = line_dedup.dedup(docs)
    assert done.columns == [c for c in docs.columns if c not in ("n_lines", "n_kept")] + ["n_lines", "n_kept"]
    assert rows(done.select("doc_id", "text", "n_lines", "n_kept")) == rows(line_dedup.dedup(docs.select("doc_id", "text")))
    model = quality.fit(docs, spark.createDataFrame([(2, 1), (4, 0)], "doc_id long, quality int"))
    scored = quality.score(docs, model)
    assert scored.columns == [c for c in docs.columns if c not in ("score", "good")] + ["score"] and scored.where("c1 = 'x'").count() == 7
    pages = docs.withColumnRenamed("doc_id", "page_id").withColumnRenamed("text", "url")
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    judged = url_filter.judge(pages, rules)
    assert sorted(judged.columns) == sorted(pages.columns) and judged.where("id = 'x' AND path IS NOT NULL").count() == 7


def test_vectors(spark):
    names = [c for c in NAMES if c not in ("label",)]
    data = [(k, [float(k % 3), 1.0], "l", *["x"] * len(names)) for k in range(60)]
    df = spark.createDataFrame(data, ", ".join(["vec_id long", "embedding array<float>", "label string", *(f"`{c}` string" for c in names)]))
    plain = df.select("vec_id", "embedding", "label")
    assert rows(vector_dedup.near_duplicates(df)) == rows(vector_dedup.near_duplicates(plain))
    assert rows(topk.search(df)) == rows(topk.search(plain))


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, docs, name, tmp_path):
    spark.createDataFrame([(2, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stage = dict(corpus_pipeline.STAGES)[name]
    plain = rows(stage(spark, docs.select("doc_id", "text"), str(tmp_path)).select("doc_id"))
    done = stage(spark, docs, str(tmp_path))
    assert rows(done.select("doc_id")) == plain
    if name != "packing":
        assert done.columns == docs.columns and done.where("_id = 'x' AND score = 'x'").count() == done.count()
