"""PWM scans: windows whose log-odds score reaches a threshold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dna import CONTEXT
from ..functions.pssm import BASES, DEFAULT_THRESHOLD, Pssm
from .sequences import pieces, spread, whole

#: Windows scored at once.
BLOCK = 1 << 20
_CODE = np.full(256, 4, np.uint8)
for _k, _b in enumerate(BASES):
    _CODE[ord(_b)] = _CODE[ord(_b.lower())] = _k
_OTHER = np.array([3, 2, 1, 0, 4], np.uint8)


def window_scores(codes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Score of each window; NaN where it holds what is no base or has no score. Columns are added from left to right."""
    length = table.shape[1]
    n = len(codes) - length + 1
    total = np.zeros(max(n, 0))
    for j in range(length):
        total += table[codes[j : j + n], j]
    return total


def scan(sequences: DataFrame, pssm: Pssm, strand: str | None = None, threshold: float = DEFAULT_THRESHOLD, around: int = CONTEXT, scores: bool = False, long_records: bool = False) -> DataFrame:
    """Matches of both strands or one; ``threshold`` is in percent of the way from the smallest score to the largest.

    On the minus strand the reverse complement is scanned and positions are turned round; contexts are forward.
    With ``scores`` also ``score``. A record's windows are scored in blocks, in Arrow batches, without a shuffle.
    With ``long_records`` sequences are cut into pieces first, which are dealt anew if there are fewer partitions than cores.
    """
    least, length = pssm.least(threshold), pssm.length
    table = np.array([[np.nan if s is None else s for s in row] for row in pssm.scores] + [[np.nan] * length])
    signs = [s for s in "+-" if strand in (None, s)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, offset, lead, core, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = (text or "").encode("ascii", "replace")
                forward = _CODE[np.frombuffer(raw, np.uint8)]
                for sign in signs:
                    codes = forward if sign == "+" else _OTHER[forward[::-1]]
                    for a in range(0, max(len(codes) - length + 1, 0), BLOCK):
                        got = window_scores(codes[a : a + BLOCK + length - 1], table)
                        at = np.flatnonzero(got >= least)  # NaN never is
                        value, at = got[at], at + a
                        if sign == "-":
                            at = len(codes) - at - length
                        own = (at >= lead) & (at < lead + core)
                        value, at = value[own], at[own]
                        if not len(at):
                            continue
                        near = [text[max(p - around, 0) : p + length + around] for p in at.tolist()]
                        cols = {"seq_id": pa.array([name] * len(at), pa.string()), "position": pa.array(at.astype(np.int64) + (offset - lead)), "match_length": pa.array(np.full(len(at), length, np.int64)), "strand": pa.array([sign] * len(at)), "context": pa.array(near, pa.string())}
                        if scores:
                            cols["score"] = pa.array(value)
                        yield pa.RecordBatch.from_pydict(cols)

    schema = "seq_id string, position long, match_length long, strand string, context string" + ", score double" * scores
    parts = spread(pieces(sequences, around, length - 1 + around)) if long_records else whole(sequences)
    return parts.select("seq_id", "offset", "lead", "core", "piece").mapInArrow(run, schema)


def scan_native(sequences: DataFrame, pssm: Pssm, strand: str = "+", threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """(seq_id, position) by column functions alone, for short sequences: each window's score is a sum over a literal table."""
    least, length = pssm.least(threshold), pssm.length
    rows = F.array(*(F.create_map(*(x for b, row in zip(BASES, pssm.scores, strict=True) if row[j] is not None for x in (F.lit(b), F.lit(row[j])))) for j in range(length)))
    from ..functions.dna import reverse_complement

    seq = F.upper("sequence") if strand == "+" else reverse_complement(F.col("sequence"))
    n = F.length("sequence")
    starts = F.when(n >= length, F.sequence(F.lit(0), n - length)).otherwise(F.array().cast("array<int>"))
    windows = sequences.select("seq_id", n.alias("n"), seq.alias("s"), F.explode(starts).alias("p"))
    windows = windows.withColumn("w", F.split(F.substring("s", F.col("p") + 1, F.lit(length)), "")).withColumn("t", rows)
    score = F.aggregate(F.sequence(F.lit(0), F.lit(length - 1)), F.lit(0.0), lambda a, j: a + F.try_element_at(F.get(F.col("t"), j), F.get(F.col("w"), j)))
    place = F.col("p") if strand == "+" else F.col("n") - F.col("p") - length
    return windows.where(score >= least).select("seq_id", place.cast("long").alias("position"))


def pssm_rows(pssm: Pssm) -> list[tuple[str, int, str, float | None]]:
    """(matrix, pos, base, score) of every cell."""
    return [(pssm.name, j, b, pssm.scores[k][j]) for k, b in enumerate(BASES) for j in range(pssm.length)]
