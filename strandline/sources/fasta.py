"""FASTA records as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_fasta(spark: SparkSession, path: str, first_only: bool = False) -> DataFrame:
    """(seq_id, header, sequence, ord) of every record, in file order by ``ord``.

    A record begins with ``>`` at the start of a line, so files are split between records. Bases are upper-cased and
    white space but tabs goes; text before the first record is ignored. ``first_only`` keeps one record.
    """
    text = spark.read.option("lineSep", "\n>").text(path).select(
        "value", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("row")).alias("ord")
    )
    # only a file's first piece still has its ">"; if it has none it lies before the first record
    at_start = F.col("ord.file_block_start") == 0
    marked = F.startswith(F.col("value"), F.lit(">"))
    opening = F.min(F.when(at_start, F.col("ord.row")))
    starts = text.groupBy("ord.file_path").agg(opening.alias("_first"))
    rows = text.join(starts, text["ord.file_path"] == starts["file_path"], "left").where((F.col("ord.row") != F.col("_first")) | ~at_start | marked)
    body = F.when((F.col("ord.row") == F.col("_first")) & at_start, F.substr("value", F.lit(2))).otherwise(F.col("value"))
    cut = F.split(body, "\n", 2)
    header = F.rtrim(F.translate(F.get(cut, F.lit(0)), "\r", ""))
    bases = F.upper(F.translate(F.coalesce(F.get(cut, F.lit(1)), F.lit("")), "\r\n ", ""))
    out = rows.select(F.regexp_extract(header, r"^\s*(\S*)", 1).alias("seq_id"), header.alias("header"), bases.alias("sequence"), "ord")
    return out.orderBy("ord").limit(1) if first_only else out
