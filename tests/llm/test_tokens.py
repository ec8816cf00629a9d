"""BPE, packing and token files against the tokenizers library and plain Python."""

import hashlib
import random
import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from strandline.llm import bpe, packing, token_files  # noqa: E402
from strandline.llm.byte_bpe import ByteBpe  # noqa: E402
from strandline.llm.shared import new_path  # noqa: E402

WORD, BYTE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, n_tokens string, `start` string"
ODD = ["", " ", "ΑΣΣ Σ ΟΔΟΣ", "İI ﬁ \x1c a\x1cb <|startoftext|> <|endoftext|>x", "\0<|endoftext|>\0", "x" * 900, "don't I'LL ²³½", "字😀12 é é"]


def texts(n=60, seed=3):
    rng = random.Random(seed)
    words = ["the", "thion", "Über", "naïve", "x9", "!!", "\n", "  ", "ß", "deux", "<|endoftext|>"]
    return ODD + [None, ODD[5], ODD[5]] + ["".join(rng.choice(words) + rng.choice(" \n'") for _ in range(rng.choice([0, 3, 40, 700, 1500]))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "clash", "clash") for k, t in enumerate(texts())]
    return spark.createDataFrame(rows + rows[5:7], SCHEMA).repartition(3), rows + rows[5:7]


def ids_of(path, text):
    return tokenizers.Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


def test_word_bpe_equals_library():
    own, library = bpe.WordBpe(WORD), tokenizers.Tokenizer.from_file(WORD)
    rng = random.Random(0)
    cases = ODD + ["".join(rng.choice("aeé'sΣ <|>\0\ń字😀12") for _ in range(rng.randint(1, 90))) for _ in range(1500)]
    for text in cases:
        want = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == want
        assert own.decode(want) == library.decode(want, skip_special_tokens=False)


def test_byte_bpe_equals_library():
    own, library = ByteBpe(BYTE), tokenizers.Tokenizer.from_file(BYTE)
    for text in texts():
        assert own.ids(text or "").tolist() == library.encode(text or "", add_special_tokens=False).ids


def test_encode_table(docs):
    df, rows = docs
    got = sorted(tuple(r) for r in bpe.encode_table(df, WORD).collect())
    library = tokenizers.Tokenizer.from_file(WORD)
    want = []
    for k, t, *_ in rows:
        i = library.encode(t or "", add_special_tokens=False).ids
        want.append((k, len(i), hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest(), hashlib.sha256(library.decode(i, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want)
    real = {r.doc_id: (r.ids, r.decoded) for r in bpe.encode_table(df, WORD, output="ids").collect()}
    assert all(real[k][0] == library.encode(t or "", add_special_tokens=False).ids for k, t, *_ in rows)


def test_pack(docs):
    df, rows = docs
    got = [r.asDict() for r in packing.pack(df, BYTE, size=256, with_ids=True).collect()]
    places, by_doc = {}, {}
    for r in got:
        assert 1 <= r["length"] <= 256 and len(r["ids"]) == r["length"]
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault(r["doc_id"], []).append(r)
    for v in places.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 256
    for k, t, *_ in rows:
        n = sum(r[0] == k for r in rows)
        parts = sorted(by_doc[k], key=lambda r: r["piece"])[::n]
        whole = ids_of(BYTE, t) + [2]
        assert [i for r in parts for i in r["ids"]] == whole
        assert [r["start"] for r in parts] == [sum(x["length"] for x in parts[:j]) for j in range(len(parts))]
        assert len(parts) == -(-len(whole) // 256) and all(r["length"] == 256 for r in parts[1:])
    total = sum(r["length"] for r in got)
    assert len(places) <= -(-total // 256) * 1.1 + 1
    assert packing.pack(df.limit(0), BYTE).count() == 0


def test_plan_fills_and_counts():
    rng = random.Random(1)
    counts = {}
    for _ in range(50_000):
        n = min(1024, int(rng.expovariate(1 / 300)) + 1)
        counts[n] = counts.get(n, 0) + 1
    slots, sequences = packing.plan(counts, 1024)
    fill = np.zeros(sequences, int)
    for length, a, b, first, _ in slots.tolist():
        fill[first : first + b - a] += length
    assert fill.max() <= 1024 and fill.sum() == sum(k * v for k, v in counts.items())
    assert sequences <= fill.sum() / 1024 * 1.01 + 1
    assert packing.plan({}, 8)[1] == 0


def test_token_files(spark, docs):
    df, rows = docs
    folder = new_path(spark, "test")
    manifest = token_files.write(df, BYTE, folder, length=64, rows=4)
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32, tuple(r.ids)) for r in token_files.read(spark, folder, manifest, with_ids=True).collect())
    at, want = 0, []
    for k, t in sorted((r[0], r[1]) for r in rows if r[1] is not None) and sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0], r[1] or "")):
        i = ids_of(BYTE, t) + [2]
        want.append((k, at, len(i), zlib.crc32(np.array(i, "<u4").tobytes()), tuple(i)))
        at += len(i)
    assert got == want
    first = manifest.orderBy("shard").first()
    path = f"{folder.removeprefix('file://')}/ids-{first["name"]}.arrow"
    stream = [i for w in want for i in w[4]][: first.tokens]
    for k in (0, 1, (first.tokens - 1) // 64):
        ids, mask = token_files.sequence(path, k)
        assert len(ids) == 64 and ids[mask].tolist() == stream[k * 64 : k * 64 + 64]
    assert token_files.write_and_read(df.limit(0), BYTE).count() == 0
