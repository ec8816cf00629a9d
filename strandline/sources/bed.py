"""Regions as BED text: chromosome, start, end, name, score, strand, separated by tabs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_bed(regions: DataFrame) -> DataFrame:
    """One text column; ``.write.text(path)`` stores it."""
    strand = F.when(F.col("strand").isin("+", "-"), F.col("strand")).otherwise(".")
    name = F.when(F.coalesce("name", F.lit("")) == "", ".").otherwise(F.col("name"))
    return regions.select(F.concat_ws("\t", "chr", F.col("start").cast("string"), F.col("end").cast("string"), name, F.lit("0"), strand).alias("value"))


def write_bed(regions: DataFrame, path: str) -> None:
    to_bed(regions).write.text(path)
