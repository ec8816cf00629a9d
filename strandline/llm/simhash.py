"""SimHash near-dedup.

Method: pigeonring filtering. A fingerprint of m segments on a ring that differs from another in at most
t bits has a segment from which every chain of consecutive segments, of any length l, differs in at most
l t / m bits. Fingerprints meet in buckets of equal segments; chains that start at the bucket's segment
prune the pairs one segment at a time, and those that are left are checked in full.

Documents with equal fingerprints are one row from the start. Buckets are cut into tiles of bounded
size, a tile gives only a forest of its links, and components come from distributed star steps.

Null and wordless texts have the fingerprint zero and are linked like any other. Long texts are read whole.
Repeated rows share their class, which is named by the smallest id (ties); an empty table gives an empty one. Only id and
text are read, so other columns cannot clash.

With ``least`` fingerprints are of the sets of shingles and only nominate: what their links connect is a group, and
within a group texts are linked if the exact Jaccard similarity of their sets is ``least`` or more. Two texts
without a word are equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import slices
from .components import components, runs, stars, tiles, whole_runs
from .shared import dropped, stored

SEED = 42
BLOCK = 4096
#: Rows whose bits are summed at once; sums of one byte hold up to 255.
STRIDE = 255
#: Texts of a block whose sets of shingles are compared; a tile has two blocks.
VERIFY = 1024
ROUNDING = 1e-9


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of every shingle, repeats included; A-Z lower-cased, words split at ASCII white space."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.r_[0, ends[:-1] + 1].tolist()
    ends = ends.tolist()
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([digest(joined, SEED)], np.uint64)
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :], strict=False)], np.uint64)


def fingerprint(hashes: np.ndarray, lanes: int = 1) -> np.ndarray:
    """``lanes`` 64-bit words; a bit is set if it is set in over half the hashes. Further lanes mix the hashes anew."""
    n, counts = len(hashes), np.zeros(64 * lanes, np.int64)
    for a in range(0, n, STRIDE):
        h = hashes[a : a + STRIDE]
        wide = np.empty((len(h), lanes), ">u8")
        wide[:, 0] = h
        for k in range(1, lanes):
            z = h + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            wide[:, k] = z ^ (z >> np.uint64(31))
        bits = np.unpackbits(wide.view(np.uint8).reshape(len(h), 8 * lanes), axis=1)
        counts += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > n).view(">u8").astype(np.uint64)


def fingerprints(docs: DataFrame, words: int, lanes: int = 1, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, fp): the fingerprint's 8 x lanes bytes, big-endian."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                fp = [fingerprint(shingle_hashes(t or "", words), lanes).astype(">u8").tobytes() for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.binary())], ["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"id {kind}, fp binary")


def set_hash(shingles: np.ndarray) -> int:
    """64 bits, signed, that tell sets of shingles (ascending hashes) apart."""
    return xxhash.xxh64_intdigest(shingles.tobytes(), SEED) - 2**63


def set_fingerprints(docs: DataFrame, words: int, lanes: int = 1, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, fp, sh): fingerprint and hash of a text's set of shingles."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                fp, sh = [], []
                for t in batch.column(1).to_pylist():
                    shingles = np.unique(shingle_hashes(t or "", words))
                    fp.append(fingerprint(shingles, lanes).astype(">u8").tobytes())
                    sh.append(set_hash(shingles))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.binary()), pa.array(sh, pa.int64())], ["id", "fp", "sh"])

    return docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"id {kind}, fp binary, sh bigint")


def segments(bits: int, m: int) -> list[tuple[int, int]]:
    """Bit ranges of m segments whose sizes differ by one at most."""
    cut = [bits * k // m for k in range(m + 1)]
    return list(zip(cut, cut[1:], strict=False))


def _masks(bits: int, m: int) -> np.ndarray:
    """(m, lanes) words with the bits of each segment."""
    out = np.zeros((m, bits), np.uint8)
    for k, (a, b) in enumerate(segments(bits, m)):
        out[k, a:b] = 1
    return np.packbits(out, axis=1).view(">u8").astype(np.uint64)


def link(classes: DataFrame, lanes: int, most: int, m: int, slack: float = 0.0, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect what is linked, of ``classes`` (id, fp) with distinct fingerprints.

    With m > ``most`` and no slack every pair within ``most`` bits is found: a chain that starts with
    an equal segment exists. With fewer segments a pair is found if one of its m segments is equal and the chains
    from it stay within their budgets plus ``slack`` times the square root of the budget.
    """
    bits, masks = 64 * lanes, _masks(64 * lanes, m)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            fp = np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u8").reshape(n, lanes)
            unpacked = np.unpackbits(fp.view(np.uint8).reshape(n, 8 * lanes), axis=1)
            keys = np.empty((n, m), np.int64)
            for k, (a, b) in enumerate(segments(bits, m)):
                keys[:, k] = unpacked[:, a:b] @ (1 << np.arange(b - a, dtype=np.int64))
            take = pa.array(np.repeat(np.arange(n), m))
            segment = pa.array(np.tile(np.arange(m, dtype=np.int16), n))
            yield pa.RecordBatch.from_arrays([segment, pa.array(keys.ravel()), batch.column(0).take(take), batch.column(1).take(take)], ["segment", "value", "id", "fp"])

    def close(x: np.ndarray, y: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """Which pairs stay within all budgets: chains from their segment first, then the full distance."""
        ok = np.arange(len(x))
        total = np.zeros(len(x), np.int64)
        for length in range(1, m):
            at = (segment[ok] + length) % m  # the first one is equal
            total = total + np.bitwise_count((x[ok] ^ y[ok]) & masks[at]).sum(axis=1, dtype=np.int64)
            budget = (length + 1) * most / m
            kept = total <= budget + slack * np.sqrt(budget)
            ok, total = ok[kept], total[kept]
            if not len(ok) or length >= 6:
                break
        return ok[np.bitwise_count(x[ok] ^ y[ok]).sum(axis=1, dtype=np.int64) <= most]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, ["segment", "value", "tile"]):
            yield from links_of(table)

    def links_of(table: pa.Table) -> Iterator[pa.RecordBatch]:
        n = table.num_rows
        if n < 2:
            return
        segment, value, tile, ids = (table.column(c).to_numpy() for c in ("segment", "value", "tile", "id"))
        fp = np.frombuffer(b"".join(table.column("fp").to_pylist()), ">u8").reshape(n, lanes).astype(np.uint64)
        start = runs(segment, value, tile)
        end = np.r_[start[1:], n]
        a_out, b_out = [], []
        of = np.repeat(np.arange(len(start)), end - start)
        small = (end - start)[of] <= 64
        rows = np.flatnonzero(small & ((end - start)[of] > 1))
        d = 1
        while len(rows):
            rows = rows[rows + d < end[of[rows]]]
            good = close(fp[rows], fp[rows + d], segment[rows]) if len(rows) else rows
            a_out.append(rows[good])
            b_out.append(rows[good] + d)
            d += 1
        for k in np.flatnonzero(end - start > 64):  # a search from link to link: what is reached is not compared again
            left = np.arange(start[k], end[k])
            while len(left):
                front, left = [left[0]], left[1:]
                while front and len(left):
                    x = front.pop()
                    hit = close(np.broadcast_to(fp[x], (len(left), lanes)), fp[left], np.full(len(left), segment[x]))
                    if len(hit):
                        new = left[hit]
                        a_out.append(np.full(len(new), x))
                        b_out.append(new)
                        front += new.tolist()
                        left = np.delete(left, hit)
        a, b = (np.concatenate(v) if v else np.empty(0, np.int64) for v in (a_out, b_out))
        if not len(a):
            return
        order = np.argsort(ids, kind="stable")  # so that the smallest position is the smallest id
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        label = stars(n, place[a], place[b])
        moved = np.flatnonzero(label != np.arange(n))
        pairs = np.unique(np.stack([ids[order[moved]], ids[order[label[moved]]]]), axis=1)
        pairs = pairs[:, pairs[0] != pairs[1]]
        for k in range(0, pairs.shape[1], 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0, k : k + 100_000]), pa.array(pairs[1, k : k + 100_000])], ["a", "b"])

    keyed = classes.select("id", "fp").mapInArrow(cut, "segment smallint, value bigint, id bigint, fp binary")
    dealt = tiles(keyed, ["segment", "value"], "id", block)
    n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(n, "segment", "value", "tile").sortWithinPartitions("segment", "value", "tile")
    return dealt.select("segment", "value", "tile", "id", "fp").mapInArrow(meet, "a bigint, b bigint")


def similar(sets: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b) of positions with Jaccard similarity ``least`` or more that connect all such pairs.

    A search from link to link: what is reached is not compared again.
    """
    n, size = len(sets), np.array([len(s) for s in sets], np.int64)
    known, code = np.unique(np.concatenate(sets), return_inverse=True) if n else (np.empty(0), np.empty(0, np.int64))
    begin = np.r_[0, np.cumsum(size)]
    marked = np.zeros(len(known), bool)
    a_out, b_out, left = [], [], np.arange(n)
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            able = left[np.minimum(size[left], size[x]) >= least * np.maximum(size[left], size[x]) - ROUNDING]
            if not len(able):
                continue
            own = code[begin[x] : begin[x + 1]]
            marked[own] = True
            of = np.repeat(np.arange(len(able)), size[able])
            places = np.arange(len(of)) - np.repeat(np.cumsum(size[able]) - size[able], size[able]) + np.repeat(begin[able], size[able])
            both = np.bincount(of, marked[code[places]], minlength=len(able))
            marked[own] = False
            new = able[both >= least * (size[able] + size[x] - both) - ROUNDING]  # empty sets: 0 of 0
            a_out.append(np.full(len(new), x))
            b_out.append(new)
            front += new.tolist()
            left = np.setdiff1d(left, new, assume_unique=True)
    return tuple(np.concatenate(v) if v else np.empty(0, np.int64) for v in (a_out, b_out))


def verified(sets: DataFrame, least: float, block: int = VERIFY) -> DataFrame:
    """Links (a, b) that connect all similar pairs within the groups of ``sets`` (group, id, sh, shingles)."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, ["group", "tile"]):
            group, tile, ids = (table.column(c).to_numpy() for c in ("group", "tile", "id"))
            held = [np.frombuffer(v, np.uint64) for v in table.column("shingles").to_pylist()]
            start = runs(group, tile)
            for at, end in zip(start.tolist(), [*start[1:].tolist(), len(ids)], strict=True):
                a, b = similar(held[at:end], least)
                if len(a):
                    a, b = ids[at:end][a], ids[at:end][b]
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    n = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = tiles(sets, ["group"], "sh", block).repartition(n, "group", "tile").sortWithinPartitions("group", "tile")
    return dealt.select("group", "tile", "id", "shingles").mapInArrow(meet, "a bigint, b bigint")


def _shingle_sets(docs: DataFrame, words: int, text: str, id_col: str) -> DataFrame:
    """(id, sh, shingles) of documents with an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                sets = [np.unique(shingle_hashes(t or "", words)) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([set_hash(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "sh", "shingles"])

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "id bigint, sh bigint, shingles binary")


def similar_documents(docs: DataFrame, least: float, words: int = 5, lanes: int = 8, most: int = 86, m: int = 32, slack: float = 1.0, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """As ``near_duplicates``, with links verified by the Jaccard similarity of the texts' sets of shingles."""
    prints = stored(set_fingerprints(docs, words, lanes, text, id_col), "fingerprints")
    classes = stored(prints.groupBy("fp", "sh").agg(F.min("id").alias("id")).where(F.col("id").isNotNull()), "classes")
    by_print = stored(classes.groupBy("fp").agg(F.min("id").alias("id"), F.count("*").alias("n")), "print-classes")
    found = components(link(by_print, lanes, most, m, slack), "simhash")
    grouped = by_print.join(found, "id", "left").select("fp", "n", F.coalesce("component", "id").alias("group"))
    several = grouped.groupBy("group").agg(F.sum("n").alias("n")).where(F.col("n") > 1).select("group")
    members = grouped.join(several, "group", "left_semi").select("fp", "group")
    nominated = stored(classes.join(members, "fp").select("group", F.col("id").cast("bigint").alias("id"), "sh"), "nominated")
    own = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text}`")).join(nominated.select(F.col("id").alias("_id")).distinct(), F.col(f"`{id_col}`") == F.col("_id"), "left_semi")
    sets = _shingle_sets(own, words, text, id_col).groupBy("id", "sh").agg(F.first("shingles").alias("shingles"))
    sets = stored(nominated.join(sets, ["id", "sh"]), "shingle-sets")
    linked = components(verified(sets, least), "similar")
    dropped(by_print, nominated, sets)
    named = classes.join(linked.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"), "left").select("sh", F.coalesce("component", "id").alias("component_id"))
    return prints.join(named, "sh", "left").select(F.col("id").alias(id_col), F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def near_duplicates(docs: DataFrame, words: int = 5, lanes: int = 1, most: int = 2, m: int = 3, slack: float = 0.0, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row for each document: id, fingerprint (hex), component_id (smallest id reachable by links)."""
    prints = stored(fingerprints(docs, words, lanes, text, id_col), "fingerprints")
    classes = stored(prints.groupBy("fp").agg(F.min("id").alias("id")).where(F.col("id").isNotNull()), "classes")
    found = components(link(classes, lanes, most, m, slack), "simhash")
    named = classes.join(found, "id", "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    return prints.join(named, "fp", "left").select(F.col("id").alias(id_col), F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
