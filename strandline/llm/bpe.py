"""BPE encoding and decoding with word-end vocabularies.

Method: a short word is held as one contiguous array of parts and one of the ranks of adjacent
pairs. The array is scanned for the minimum rank (leftmost on ties), the boundary there is deleted
and the two neighbouring ranks are looked up anew, until no pair has a rank. The distinct words of a
batch of the same length are rows of one matrix, so a scan handles all of them at once; words over
``SHORT`` bytes use a heap over a linked list, which gives the same merges without the quadratic scan.

Null texts are encoded as empty ones: no ids, empty decoded text. Repeated rows give repeated rows;
an empty table an empty one; further columns are kept unless their names are those of a result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHORT = 40
NONE = np.iinfo(np.int32).max
#: Unicode's White_Space characters.
SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Words kept with their codes from batch to batch, in each Python worker.
CACHED_WORDS = 150_000


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = iter(range(256, 512))
    shown = set(plain)
    return [chr(b if b in shown else next(others)) for b in range(256)]


class WordBpe:
    """A tokenizer file of the kind: NFC, lower case, words by pattern, byte-level BPE with a word-end suffix."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.last = np.array([vocab[c + suffix] for c in letters], np.int32)
        self.token = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token.update({i: t for t, i in self.special.items()})
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        key = np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], np.int64)
        new = np.array([vocab[a + b] for a, b in pairs], np.int32)
        by_key = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.news = key[by_key], by_key.astype(np.int32), new[by_key]
        self.pairs = {int(k): (r, int(n)) for r, (k, n) in enumerate(zip(key, new, strict=True))}
        self.words = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACES}\p{{L}}\p{{N}}]+")
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known: dict[str, tuple[str, str, int]] = {}

    def split(self, text: str) -> list[str]:
        """The words of a text; special tokens stand as they are."""
        if self.cut is None or "<" not in text:
            return self._words(text)
        out: list[str] = []
        for k, piece in enumerate(self.cut.split(text)):
            if k % 2:
                out.append("\0" + piece)  # no word holds a NUL before a "<": see _words
            elif piece:
                out.extend(self._words(piece))
        return out

    def _words(self, text: str) -> list[str]:
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        found = self.words.findall(text.replace("Σ", "σ").lower())
        if "\0" in text:  # keeps a word that looks like a marked special token apart from it
            found = [w if w[0] != "\0" else "\0\0" + w for w in found]
        return found

    def _rank_at(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (left.astype(np.int64) << 32) | right.astype(np.int64)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.ranks[at], NONE), at

    def _short(self, words: list[bytes]) -> list[list[int]]:
        """Ids of words of one length."""
        n, width = len(words), len(words[0])
        raw = np.frombuffer(b"".join(words), np.uint8).reshape(n, width)
        parts = np.concatenate([self.inner[raw[:, :-1]], self.last[raw[:, -1:]]], axis=1)
        out: list[list[int]] = [[] for _ in range(n)]
        rows = np.arange(n)
        ranks, _ = self._rank_at(parts[:, :-1], parts[:, 1:])
        while len(rows):
            if parts.shape[1] == 1:
                for r, i in zip(rows.tolist(), parts[:, 0].tolist(), strict=True):
                    out[r] = [i]
                break
            at = ranks.argmin(axis=1)
            line = np.arange(len(rows))
            open_ = ranks[line, at] != NONE
            if not open_.all():
                for r, p in zip(rows[~open_].tolist(), parts[~open_].tolist(), strict=True):
                    out[r] = p
                rows, parts, ranks, at = rows[open_], parts[open_], ranks[open_], at[open_]
                line = np.arange(len(rows))
                if not len(rows):
                    break
            # every open row merges once a pass, so all open rows stay equally long
            _, where = self._rank_at(parts[line, at], parts[line, at + 1])
            parts[line, at] = self.news[where]
            width = parts.shape[1] - 1
            keep = np.arange(width)[None, :] + (np.arange(width)[None, :] > at[:, None])
            parts = np.take_along_axis(parts, keep, axis=1)
            if width == 1:
                ranks = np.empty((len(rows), 0), np.int32)
                continue
            gone = np.arange(width - 1)[None, :]
            ranks = np.take_along_axis(ranks, gone + (gone >= at[:, None]), axis=1)
            for side in (at - 1, at):
                ok = (side >= 0) & (side < width - 1)
                ranks[line[ok], side[ok]] = self._rank_at(parts[line[ok], side[ok]], parts[line[ok], side[ok] + 1])[0]
        return out

    def _long(self, word: bytes) -> list[int]:
        ids = [*self.inner[np.frombuffer(word[:-1], np.uint8)].tolist(), int(self.last[word[-1]])]
        after = [*range(1, len(ids)), -1]
        before = [*range(-1, len(ids) - 1)]
        heap = [(p[0], k) for k in range(len(ids) - 1) if (p := self.pairs.get((ids[k] << 32) | ids[k + 1]))]
        heapq.heapify(heap)
        while heap:
            rank, k = heapq.heappop(heap)
            nxt = after[k]
            if ids[k] < 0 or nxt < 0 or (p := self.pairs.get((ids[k] << 32) | ids[nxt])) is None or p[0] != rank:
                continue
            ids[k], ids[nxt] = p[1], -1
            after[k] = after[nxt]
            if after[nxt] >= 0:
                before[after[nxt]] = k
            for a, b in ((before[k], k), (k, after[k])):
                if a >= 0 and b >= 0 and (p := self.pairs.get((ids[a] << 32) | ids[b])):
                    heapq.heappush(heap, (p[0], a))
        return [i for i in ids if i >= 0]

    def encode_words(self, words: list[str]) -> dict[str, list[int]]:
        """Ids of each distinct word."""
        out: dict[str, list[int]] = {}
        sized: dict[int, list[tuple[str, bytes]]] = {}
        for w in words:
            if w[0] == "\0":
                if w[1:] in self.special:
                    out[w] = [self.special[w[1:]]]
                    continue
                raw = w[2:].encode()
            else:
                raw = w.encode()
            if len(raw) > SHORT:
                out[w] = self._long(raw)
            else:
                sized.setdefault(len(raw), []).append((w, raw))
        for group in sized.values():
            out.update(zip((w for w, _ in group), self._short([b for _, b in group]), strict=True))
        return out

    def encode(self, text: str) -> list[int]:
        words = self.split(text)
        ids = self.encode_words(list(set(words)))
        return [i for w in words for i in ids[w]]

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by spaces, special ones too: such files name no decoder."""
        return " ".join(self.token[i] for i in ids)

    def codes(self, texts: list[str]) -> Iterator[list[tuple[str, str, int]]]:
        """For each text its words' (ids joined by a space, decoded ids, number of ids)."""
        split = [self.split(t) for t in texts]
        missing = {w for words in split for w in words} - self.known.keys()
        here = {w: (" ".join(map(str, i)), self.decode(i), len(i)) for w, i in self.encode_words(list(missing)).items()}
        table = self.known
        if len(table) < CACHED_WORDS:
            table.update(here)
            here = {}
        for words in split:
            yield [table.get(w) or here[w] for w in words] if here else [table[w] for w in words]


_loaded: dict[str, WordBpe] = {}


def tokenizer(path: str) -> WordBpe:
    """One for each Python worker."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def encode_table(docs: DataFrame, path: str, text: str = "text", id_col: str = "doc_id", output: str = "digest") -> DataFrame:
    """Encodes every text and decodes its ids again; narrow, no shuffle.

    ``output="ids"`` gives columns ``ids`` (array<int>) and ``decoded``; ``"digest"`` gives
    ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``.
    """
    digest = output == "digest"
    kind = docs.schema[id_col].dataType.simpleString()
    made = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for whole in batches:
            for batch in slices(whole, 1):
                texts = [t or "" for t in batch.column(1).to_pylist()]
                n, first, second = [], [], []
                for codes in bpe.codes(texts):
                    n.append(sum([c[2] for c in codes]))
                    ids, decoded = " ".join([c[0] for c in codes]), " ".join([c[1] for c in codes])
                    first.append(hashlib.sha256(ids.encode()).hexdigest() if digest else list(map(int, ids.split())))
                    second.append(hashlib.sha256(decoded.encode()).hexdigest() if digest else decoded)
                cols = [pa.array(n, pa.int64())] * digest + [pa.array(first, pa.string() if digest else pa.list_(pa.int32())), pa.array(second, pa.string())]
                names = ["n_tokens", "ids_sha256", "decoded_sha256"] if digest else ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays([batch.column(0), *cols], [id_col, *names])

    return docs.select(F.col(id_col), F.col(text).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, {made}")


def slices(batch: pa.RecordBatch, text_column: int, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text each, at least one row; bounds what a worker holds."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(text_column)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes) // most
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:], strict=False):
        yield batch.slice(a, b - a)
