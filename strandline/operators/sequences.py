"""Sequences cut into pieces that tasks can share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bases of a piece. Column functions walk strings from their start, so pieces stay short.
PIECE = 16_384


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt anew if it comes in fewer partitions than there are cores, as from one small file; else as it is."""
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def pieces(sequences: DataFrame, before: int, after: int, size: int = PIECE) -> DataFrame:
    """(seq_id, offset, lead, core, piece): bases [offset - lead, offset + core + after) of each sequence, lead up to ``before``.

    A hit belongs to the piece whose core holds its start, so with ``after`` bases behind it every hit of up to
    after + 1 bases is found once. One pass over each record.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = text or ""
                starts = list(range(0, max(len(text), 1), size))
                for k in range(0, len(starts), 256):
                    part = starts[k : k + 256]
                    yield pa.RecordBatch.from_pydict({
                        "seq_id": pa.array([name] * len(part), pa.string()),
                        "offset": pa.array(part, pa.int64()),
                        "lead": pa.array([min(a, before) for a in part], pa.int64()),
                        "core": pa.array([min(size, len(text) - a) for a in part], pa.int64()),
                        "piece": pa.array([text[max(a - before, 0) : a + size + after] for a in part], pa.string()),
                    })

    return sequences.select(F.col("seq_id").cast("string"), "sequence").mapInArrow(run, "seq_id string, offset long, lead long, core long, piece string")


def whole(sequences: DataFrame) -> DataFrame:
    """Each sequence as its one piece; no pass at all. For sequences of up to some ten thousand bases."""
    none = F.lit(0).cast("long")
    return sequences.select(F.col("seq_id").cast("string").alias("seq_id"), none.alias("offset"), none.alias("lead"), F.length("sequence").cast("long").alias("core"), F.col("sequence").alias("piece"))
