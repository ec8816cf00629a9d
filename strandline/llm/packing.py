"""Best-fit packing of documents into sequences of a fixed length.

Method: length-histogram planning. The pieces' lengths are counted (at most ``size`` counts reach the
driver, whatever the corpus), best-fit decreasing runs over the counts, and pieces then take the planned
slots by joining on their rank within their length. Ranks are dense without any sort or single task:
each task numbers its own pieces of a length, and the counts of (length, task) are summed up before it.

Null texts are packed as empty ones (one end id); repeated rows are packed each on their own; an empty
table gives an empty one. Only documents longer than a sequence are cut, however long; the first piece takes the rest.
Which of several pieces of the same length takes which slot is open (ties). Only id and text are read, so other columns
cannot clash.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import slices
from .byte_bpe import tokenizer
from .shared import stored

def plan(counts: dict[int, int], size: int) -> tuple[np.ndarray, int]:
    """Best-fit decreasing over counts.

    Returns slot ranges (length, first rank, last rank + 1, sequence of the first rank, offset), ordered,
    and the number of sequences. Ranks r of a range go to sequence (first sequence + r - first rank).

    Ranges are bounded by ``size`` alone, whatever the counts: a range ends its length or uses up an open group of equal
    sequences, whose room shrinks by it. A length opens three groups at most, and a group takes size / length ranges of a
    length, so there are fewer than 3 size^2 (1 + log size).
    """
    slots: list[tuple[int, int, int, int, int]] = []
    open_: dict[int, list[tuple[int, int]]] = {}  # room left: [(first sequence, how many)]
    rooms: list[int] = []
    sequences = 0

    def put(room: int, first: int, n: int) -> None:
        if room:
            if room not in open_:
                open_[room] = []
                insort(rooms, room)
            open_[room].append((first, n))

    for length in sorted((k for k, n in counts.items() if n), reverse=True):
        left, rank = counts[length], 0
        while left:
            k = bisect_left(rooms, length)
            if k < len(rooms):  # the tightest room that fits
                room = rooms[k]
                first, n = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(k)
                used = min(n, left)
                if used < n:
                    put(room, first + used, n - used)
            else:  # new sequences, each filled with as many of this length as fit
                room, each = size, size // length
                used = max(1, left // each) if left >= each else 1
                first, sequences = sequences, sequences + used
            slots.append((length, rank, rank + used, first, size - room))
            put(room - length, first, used)
            rank, left = rank + used, left - used
    return np.array(sorted(slots), np.int64).reshape(-1, 5), sequences


def pieces(docs: DataFrame, path: str, size: int = 1024, end_id: int = 2, text: str = "text", id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """The pieces of every document with their task's number and their rank within (task, length)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, task = tokenizer(path).ids, TaskContext.get().partitionId()
        seen = np.zeros(size + 1, np.int64)
        for whole in batches:
            for batch in slices(whole, 1):
                rows, piece, start, length, crc, values = [], [], [], [], [], []
                for row, t in enumerate(batch.column(1).to_pylist()):
                    ids = np.append(ids_of(t or ""), end_id).astype("<u4")
                    cuts = [0, *range(len(ids) % size or size, len(ids) + 1, size)] if len(ids) > size else [0, len(ids)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        rows.append(row)
                        piece.append(k)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(ids[a:b].tobytes()))
                        if with_ids:
                            values.append(ids[a:b].tolist())
                sizes = np.array(length)
                order = np.argsort(sizes, kind="stable")
                ordered = sizes[order]
                runs = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
                rank = np.empty(len(sizes), np.int64)
                rank[order] = np.arange(len(sizes)) - np.repeat(runs, np.diff(np.r_[runs, len(sizes)])) + seen[ordered]
                seen += np.bincount(sizes, minlength=size + 1)
                cols = [batch.column(0).take(pa.array(rows)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(np.full(len(rows), task, np.int32)), pa.array(rank)]
                names = [id_col, "piece", "start", "length", "ids_crc32", "task", "rank"]
                if with_ids:
                    cols.append(pa.array(values, pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, task int, rank long" + ", ids array<long>" * with_ids
    return docs.select(F.col(id_col), F.col(text).cast("string")).mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, size: int = 1024, end_id: int = 2, text: str = "text", id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row for each piece: id, piece, start, length, ids_crc32, sequence_id, offset (and ids)."""
    cut = stored(pieces(docs, path, size, end_id, text, id_col, with_ids), "pieces")
    per_task = cut.groupBy("length", "task").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `size` rows
    slots, _ = plan(counts, size)
    before = per_task.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = cut.join(before.select("length", "task", F.coalesce("before", F.lit(0)).alias("before")), ["length", "task"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("before"))
    keep = [c for c in cut.columns if c not in ("task", "rank")]
    shared = docs.sparkSession.sparkContext.broadcast(slots)  # bounded by the size of a sequence

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        key = table[:, 0] * (1 << 44) + table[:, 1]
        for batch in batches:
            if not batch.num_rows:
                continue
            rank = batch.column(len(keep)).to_numpy()
            at = np.searchsorted(key, batch.column("length").to_numpy() * (1 << 44) + rank, side="right") - 1
            where = [pa.array(table[at, 3] + rank - table[at, 1]), pa.array(table[at, 4])]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *where], [*keep, "sequence_id", "offset"])

    kinds = {f.name: f.dataType.simpleString() for f in cut.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", sequence_id long, offset long"
    return ranked.select(*keep, "rank").mapInArrow(place, schema)
