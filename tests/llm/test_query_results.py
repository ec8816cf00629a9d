"""The registered queries that SQL cannot express, against plain Python over the whole of the smallest tables."""

import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash
from test_simhash import groups
from tokenizers import Tokenizer

from strandline.llm import queries

SF = "/root/testdata/sf0.001"
public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def run(spark, name):
    return queries.queries()[name](spark, SF).collect()


def encoded(texts):
    """Ids with the end id, by document in ascending order."""
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.no_truncation()
    library.no_padding()
    return {k: [*library.encode(texts[k], add_special_tokens=False).ids, 2] for k in sorted(texts)}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op4(spark, texts):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    want = {}
    for k, t in texts.items():
        ids = library.encode(t, add_special_tokens=False).ids
        want[k] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in run(spark, "op4_bpe")} == want


def test_op5(spark, texts):
    got, ids = run(spark, "op5_packing"), encoded(texts)
    want = []
    for k, v in ids.items():
        cuts = [0, *range(len(v) % 1024 or 1024, len(v) + 1, 1024)] if len(v) > 1024 else [0, len(v)]
        want += [(k, i, a, b - a, crc(v[a:b])) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    filled = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert filled.get(r.sequence_id, 0) == r.offset
        filled[r.sequence_id] = r.offset + r.length
    total = sum(r.length for r in got)
    assert max(filled.values()) <= 1024 and len(filled) <= -(-total // 1024) * 1.02 + 1


def test_op7(spark, texts):
    prints = {}
    for k, t in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints[k] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    ids = sorted(prints)
    near = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 2]
    up = groups(ids, near)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in run(spark, "op7_simhash")} == {k: (f"{prints[k]:016x}", up[k]) for k in ids}


def test_op8(spark, texts):
    want, start = {}, 0
    for k, v in encoded(texts).items():
        want[k] = (start, len(v), crc(v))
        start += len(v)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in run(spark, "op8_token_files")} == want


def test_op10(spark, texts):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = {r.doc_id: r for r in run(spark, "op10_quality")}
    assert got.keys() == texts.keys()
    for k, r in got.items():
        assert r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    held = [k for k in labels if k in got and got[k].held_out]
    assert np.mean([got[k].predicted == labels[k] for k in held]) >= 0.9
