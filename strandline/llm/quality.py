"""Quality of documents from their lines.

Method: a linear-chain conditional random field labels every line good or bad from features of the line
and of its two neighbours; forward-backward marginals, weighted by line length, give a document's share
of good text, and a logistic curve fitted on the training rows turns that into its score.

Features are a line's length, words, character classes, repeats, and its words by hash. Only the text goes into a score.
Training takes a sample of labelled rows outside the held-out fold, by the smallest hashes of their ids: at most
``most_docs`` rows with at most ``most_lines`` lines and ``most_chars`` characters in sum, each row with its whole text as
one chain; a line's label is its document's. Scoring is narrow: every document, every line, no shuffle.

A null or empty text is one empty line. Long texts are worked on whole, by themselves if need be (a text larger than
the sample's bounds is scored like any other, but never in the sample). Repeated rows get the same score each; ties in the
order of the sample are rows that are equal. An empty table gives an empty one; without labelled rows of both
kinds every score is the share of label 1, or 0.5. Columns of the documents are kept, whatever their names;
one called score (or good, with ``lines``) is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bpe import slices
from .shared import free_name

STEPS = 60
#: Bytes of text whose features are made at once; each takes about 100 bytes of arrays meanwhile.
SLICE = 500_000
KINDS = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "space": b" \t\r\x0b\x0c", "point": b".,;:?'\"-()", "call": b"!", "bar": b"|", "sign": b"#$%&*@^~=+<>{}[]\\_/`"}
CLASS = np.full(256, len(KINDS), np.uint8)  # what is left: control and non-ASCII bytes
for _k, _chars in enumerate(KINDS.values()):
    CLASS[list(_chars)] = _k
CLASSES = len(KINDS) + 1
LAGS = (1, 2, 3)
#: Words are counted by so many values of their hash.
HASHED = 32
WIDTH = 3 + CLASSES + len(LAGS) + 2 + HASHED
_ODD = np.uint64(0x9E3779B97F4A7C15)


def line_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Features of lines [starts, ends) of a byte buffer; ``first`` marks the first line of each document."""
    n, size = len(starts), ends - starts
    inside = np.repeat(np.arange(n), size)
    at = np.repeat(starts - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(len(inside))
    chars = data[at]
    counts = np.bincount(inside * CLASSES + CLASS[chars], minlength=n * CLASSES).reshape(n, CLASSES)
    solid = CLASS[chars] != list(KINDS).index("space")
    edge = np.r_[True, inside[1:] != inside[:-1]] if len(inside) else np.empty(0, bool)
    begins = np.flatnonzero(solid & (edge | ~np.r_[False, solid[:-1]])) if len(inside) else np.empty(0, np.int64)
    line = inside[begins]
    words = np.bincount(line, minlength=n)
    if len(begins):  # sums over a word of byte times a hash of its place in the word
        begun = np.zeros(len(inside), np.int64)
        begun[begins] = 1
        word = np.cumsum(begun) - 1
        place = (np.arange(len(inside)) - begins[word]).astype(np.uint64) + np.uint64(1)
        mixed = (place * _ODD ^ (place >> np.uint64(3))) * (chars.astype(np.uint64) * _ODD + place)
        code = np.add.reduceat(np.where(solid, mixed, np.uint64(0)), begins)
    else:
        code = np.empty(0, np.uint64)
    some = np.maximum(size, 1)
    again = []
    for lag in LAGS:
        same = (code[lag:] == code[:-lag]) & (line[lag:] == line[:-lag]) if len(code) > lag else np.empty(0, bool)
        again.append(np.bincount(line[lag:][same], minlength=n) / np.maximum(words, 1))
    whole = np.zeros(n, np.uint64)
    np.add.at(whole, line, code * (np.arange(len(code)).astype(np.uint64) - np.r_[0, np.cumsum(words)[:-1]].astype(np.uint64)[line] + np.uint64(7)))
    repeats = np.r_[False, (whole[1:] == whole[:-1]) & (size[1:] > 0)] & ~first
    by_word = np.bincount(line * HASHED + (code >> np.uint64(40)).astype(np.int64) % HASHED, minlength=n * HASHED).reshape(n, HASHED)
    cols = [np.log1p(size), np.log1p(words), (size - counts[:, 3]) / np.maximum(words, 1) / 10, *(counts / some[:, None]).T, *again, *(by_word / np.maximum(words, 1)[:, None]).T, repeats, size == 0]
    return np.stack([c.astype(np.float32) for c in cols], axis=1)


def lines_of(batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, row) of all lines of a string column; a null is an empty line."""
    texts = batch.column(column).cast(pa.large_string()).fill_null("")
    edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    low, high = int(edges[0]), int(edges[-1])
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[low:high]
    edges = edges - low
    breaks = np.flatnonzero(data == 10)
    row = np.searchsorted(edges, breaks, side="right") - 1
    count = 1 + np.bincount(row, minlength=len(texts))
    first = np.cumsum(count) - count
    starts, ends = np.empty(count.sum(), np.int64), np.empty(count.sum(), np.int64)
    inner = np.arange(len(breaks)) + row  # the line that a break ends
    ends[inner], starts[inner + 1] = breaks, breaks + 1
    starts[first], ends[first + count - 1] = edges[:-1], edges[1:]
    return data, starts, ends, np.repeat(np.arange(len(texts)), count)


def beside(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each line's features, those of the lines before and after it in its document, and the bias."""
    last = np.r_[first[1:], True]
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[first], after[last] = 0, 0
    return np.concatenate([x, before, after, first[:, None], last[:, None], np.ones((len(x), 1))], axis=1)


def _products(m: np.ndarray, longest: int) -> np.ndarray:
    """Running products of 2x2 matrices, scaled; exact for chains of up to ``longest`` since a chain's first matrix forgets what lies before."""
    a, b, c, e = (np.ascontiguousarray(m[:, i, j]) for i in (0, 1) for j in (0, 1))
    d = 1
    while d < longest:  # [a b; c e] of lines d before, times its own
        w, x, y, z = a[:-d], b[:-d], c[:-d], e[:-d]
        new = w * a[d:] + x * c[d:], w * b[d:] + x * e[d:], y * a[d:] + z * c[d:], y * b[d:] + z * e[d:]
        top = np.maximum(np.maximum(new[0], new[1]), np.maximum(new[2], new[3]))
        a, b, c, e = (np.concatenate([old[:d], v / top]) for old, v in zip((a, b, c, e), new, strict=True))
        d *= 2
    return np.stack([a, b, c, e], axis=1).reshape(-1, 2, 2)


def marginals(unary: np.ndarray, move: np.ndarray, first: np.ndarray, pairs: bool = False):
    """P(good) of every line; with ``pairs`` also the summed probabilities of transitions.

    unary: log-odds of good of each line; move: log-potentials [from, to], 0 bad and 1 good.
    """
    at = np.flatnonzero(first)
    longest = int(np.diff(np.r_[at, len(first)]).max())
    up = np.clip(unary, -30, 30)
    own = np.stack([np.exp(-up / 2), np.exp(up / 2)], axis=1)
    step = np.exp(move)[None] * own[:, None, :]
    forward = np.where(first[:, None, None], own[:, None, :], step)
    alpha = _products(forward, longest)[:, 0]
    last = np.r_[first[1:], True]
    back = np.full_like(step, 0.5)
    back[:-1][~last[:-1]] = step[1:][~last[:-1]]
    beta = _products(back[::-1].transpose(0, 2, 1), longest)[::-1].transpose(0, 2, 1).sum(axis=2)
    both = alpha * beta
    good = both[:, 1] / both.sum(axis=1)
    if not pairs:
        return good
    inner = np.flatnonzero(~first)
    joint = alpha[inner - 1][:, :, None] * step[inner] * beta[inner][:, None, :]
    return good, (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    move: np.ndarray
    slope: float
    shift: float

    def score_lines(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return marginals(beside((x - self.mean) / self.scale, first) @ self.weight, self.move, first)

    def score_docs(self, good: np.ndarray, size: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        weight = size + 1e-3
        share = np.bincount(row, good * weight, minlength=n) / np.maximum(np.bincount(row, weight, minlength=n), 1e-9)
        return 1 / (1 + np.exp(-np.clip(self.slope * _logit(share) + self.shift, -30, 30)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _train(x: np.ndarray, size: np.ndarray, row: np.ndarray, label: np.ndarray) -> Model:
    """``row``: document of each line, ascending; ``label``: of each document."""
    n, rate = len(label), label.mean() if len(label) else 0.5
    if not len(label) or not 0 < rate < 1:
        return Model(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(3 * WIDTH + 3), np.zeros((2, 2)), 0.0, float(_logit(np.array(rate))) if len(label) else 0.0)
    first = np.r_[True, row[1:] != row[:-1]]
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    z, gold = beside((x - mean) / scale, first), label[row].astype(float)
    # lines count by their documents: each document weighs as much as any other of its label, and both labels the same
    per_line = (1 / np.bincount(row, minlength=n))[row]
    weight = per_line * np.where(gold == 1, 0.5 / rate, 0.5 / (1 - rate))
    weight /= weight.mean()
    seen = np.zeros((2, 2))
    inner = np.flatnonzero(~first)
    np.add.at(seen, (gold[inner - 1].astype(int), gold[inner].astype(int)), 1.0)
    w, move = np.zeros(z.shape[1]), np.zeros((2, 2))
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (w, move)]
    for k in range(1, STEPS + 1):
        good, pair = marginals(z @ w, move, first, pairs=True)
        grads = (z.T @ (weight * (gold - good)) / len(z) - 1e-3 * w, (seen - pair) / len(z) - 1e-2 * move)
        for p, g, (m, v) in zip((w, move), grads, state, strict=True):
            m[:] = 0.9 * m + 0.1 * g
            v[:] = 0.99 * v + 0.01 * g * g
            p += 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    model = Model(mean, scale, w, move, 1.0, 0.0)
    good = model.score_lines(x, first)
    share = np.bincount(row, good * (size + 1e-3), minlength=n) / np.bincount(row, size + 1e-3, minlength=n)
    a, b, s = 1.0, 0.0, _logit(share)
    for _ in range(30):  # Newton steps of a lightly penalised logistic curve
        p = 1 / (1 + np.exp(-np.clip(a * s + b, -30, 30)))
        d = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((label - p) * s).sum() - (a - 1), (label - p).sum() - 0.1 * b])
        h = np.array([[(d * s * s).sum() + 1, (d * s).sum()], [(d * s).sum(), d.sum() + 0.1]])
        da, db = np.linalg.solve(h, g)
        a, b = a + float(np.clip(da, -1, 1)), b + float(np.clip(db, -1, 1))
    model.slope, model.shift = max(a, 0.05), b
    return model


def held_out(id_col: Column | str = "doc_id") -> Column:
    """The fold that training leaves out: crc32 of the id as text, mod 5, is 0. A null id counts as an empty text."""
    column = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, most_docs: int = 2000, text: str = "text", id_col: str = "doc_id", label: str = "quality", most_lines: int = 200_000, most_chars: int = 20_000_000) -> Model:
    """Fits the model on a bounded sample of labelled rows; contradicting labels of an id count as 0."""
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label}`").alias("label")).where("label IS NOT NULL AND id IS NOT NULL").where(~held_out("id"))
    known = known.groupBy("id").agg(F.min("label").cast("int").alias("label"))
    sample = known.orderBy(F.xxhash64("id"), "id").limit(most_docs)  # at most most_docs rows of an id and a number
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(sample), "id").withColumn("chars", F.octet_length("text"))
    lines = F.col("chars") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    # an id may have many rows: again the first most_docs, and of those as many as the bounds allow
    rows = rows.withColumn("lines", lines).where((F.col("lines") <= most_lines) & (F.col("chars") <= most_chars))
    order = [F.xxhash64("id"), "id", F.xxhash64("text")]
    rows = rows.orderBy(*order).limit(most_docs)
    upto = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # over at most most_docs rows
    rows = rows.withColumns({"all_lines": F.sum("lines").over(upto), "all_chars": F.sum("chars").over(upto)})
    rows = rows.where((F.col("all_lines") <= most_lines) & (F.col("all_chars") <= most_chars)).select("text", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 0, SLICE):
                data, starts, ends, row = lines_of(batch, 0)
                x = line_features(data, starts, ends, np.r_[True, row[1:] != row[:-1]])
                cut = np.flatnonzero(np.diff(row)) + 1
                cols = [pa.array([p.tobytes() for p in np.split(x, cut)]), pa.array([p.tobytes() for p in np.split(ends - starts, cut)]), batch.column(1)]
                yield pa.RecordBatch.from_arrays(cols, ["x", "size", "label"])

    got = rows.mapInArrow(run, "x binary, size binary, label int").collect()  # bounded by most_docs, most_lines and most_chars
    got.sort(key=lambda r: (r["x"], r["label"]))
    x = [np.frombuffer(r["x"], np.float32).reshape(-1, WIDTH) for r in got]
    row = np.repeat(np.arange(len(x)), [len(v) for v in x])
    empty = np.empty((0, WIDTH), np.float32)
    size = np.concatenate([np.frombuffer(r["size"], np.int64) for r in got]) if got else np.empty(0, np.int64)
    return _train(np.concatenate(x) if x else empty, size, row, np.array([r["label"] for r in got], int))


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, lines: bool = False) -> DataFrame:
    """``docs`` (columns ``keep``, or all) with ``score``; with ``lines`` also ``good``, P(good) of every line."""
    keep = [c for c in docs.columns if c not in ("score", "good")] if keep is None else keep
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    extra = ["good"] * lines
    again = [] if text in keep and kinds[text] == "string" else [F.col(f"`{text}`").cast("string").alias(free_name(docs, "text_"))]
    at = len(keep) if again else keep.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, at, SLICE):
                data, starts, ends, row = lines_of(batch, at)
                first = np.r_[True, row[1:] != row[:-1]]
                good = model.score_lines(line_features(data, starts, ends, first), first)
                cols = [pa.array(model.score_docs(good, ends - starts, row, batch.num_rows))]
                if lines:
                    cols.append(pa.ListArray.from_arrays(np.r_[np.flatnonzero(first), len(row)].astype(np.int32), pa.array(good)))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *cols], [*keep, "score", *extra])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "score double", *["good array<double>"] * lines])
    return docs.select(*(F.col(f"`{c}`") for c in keep), *again).mapInArrow(run, schema)
