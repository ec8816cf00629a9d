"""Motif search on streams of sequences. A search sees one record at a time, so it keeps no state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..operators.motif import find_literal
from ..operators.pwm import scan


def find_in_stream(sequences: DataFrame, pattern: str, strand: str = "+") -> DataFrame:
    """Literal hits of one strand in a streaming (seq_id, sequence) table."""
    return find_literal(sequences, pattern, strand)


def scan_stream(sequences: DataFrame, pssm, strand: str | None = None, threshold: float = 75.0) -> DataFrame:
    """Matches of a matrix in a streaming (seq_id, sequence) table, with their scores."""
    return scan(sequences, pssm, strand, threshold, scores=True)


def write_matches(matches: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A writer of Parquet files; start() it."""
    return matches.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
