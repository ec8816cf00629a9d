"""GFF3 features as regions, with derived promoters and transcription start sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import REGION_COLUMNS

PROMOTER = 250
FIELDS = ["chr", "source", "type", "start", "end", "score", "strand", "phase"]


def attribute(attributes: Column, key: str, strict: bool = True) -> Column:
    """An attribute's value up to the next semicolon, or an empty text; without ``strict`` ``key=`` may end a longer key."""
    return F.regexp_extract(attributes, ("(?:^|;)\\s*" if strict else "") + key + "=([^;]*)", 1)


def parse_gff3(lines: DataFrame, strict: bool = True) -> DataFrame:
    """Regions of lines (value, ord). Rows that cannot be read are left out, and so are starts below 1."""
    split = r"^([^\t]*)\t([^\t]*)\t([^\t]*)\t(\d+)\t(\d+)\t([^\t]*)\t([^\t]*)\t([^\t]*)(?:\t(.*))?$" if strict else r"^\s*(\S+)\s+(\S+)\s+(\S+)\s+(\d+)\s+(\d+)\s+(\S+)\s+(\S+)\s+(\S+)\t?(.*)$"
    value = F.translate("value", "\r", "")
    rows = lines.where((value != "") & ~F.startswith(F.col("value"), F.lit("#"))).where(value.rlike(split))
    part = [F.regexp_extract(value, split, k + 1).alias(c) for k, c in enumerate([*FIELDS, "attributes"])]
    rows = rows.select(*part, "ord").withColumn("s", F.expr("try_cast(start AS BIGINT)")).withColumn("e", F.expr("try_cast(end AS BIGINT)"))
    rows = rows.where((F.col("s") >= 1) & F.col("e").isNotNull())
    name = F.coalesce(F.nullif(attribute(F.col("attributes"), "Name", strict), F.lit("")), attribute(F.col("attributes"), "ID", strict))
    return rows.select("chr", (F.col("s") - 1).alias("start"), F.col("e").alias("end"), "strand", "type", name.alias("name"), F.lit("").alias("sequence"), F.struct(F.lit(0).alias("derived"), F.col("ord").alias("line"), F.lit(0).alias("part")).alias("ord"))


def derive_promoters(regions: DataFrame, around: int = PROMOTER) -> DataFrame:
    """The bases before each gene: of forward genes those before the start, of others those after the end."""
    forward = F.col("strand") == "+"
    genes = regions.where(F.col("type") == "gene")
    start = F.when(forward, F.greatest(F.col("start") - around, F.lit(0))).otherwise(F.col("end"))
    end = F.when(forward, F.col("start")).otherwise(F.col("end") + around)
    out = genes.withColumns({"start": start, "end": end, "type": F.lit("promoter"), "name": F.concat("name", F.lit("_promoter"))})
    return _derived(out, 0).where(F.col("start") < F.col("end"))


def derive_tss(regions: DataFrame) -> DataFrame:
    """The first transcribed base of each gene."""
    forward = F.col("strand") == "+"
    genes = regions.where(F.col("type") == "gene")
    start = F.when(forward, F.col("start")).otherwise(F.col("end") - 1)
    end = F.when(forward, F.col("start") + 1).otherwise(F.col("end"))
    return _derived(genes.withColumns({"start": start, "end": end, "type": F.lit("TSS"), "name": F.concat("name", F.lit("_TSS"))}), 1)


def _derived(rows: DataFrame, part: int) -> DataFrame:
    if "ord" not in rows.columns:
        return rows
    return rows.withColumn("ord", F.struct(F.lit(1).alias("derived"), F.col("ord.line").alias("line"), F.lit(part).alias("part")))


def read_gff3(spark: SparkSession, path: str, strict: bool = True, derive: bool = True) -> DataFrame:
    """Regions of a file with ``ord``; with ``strict`` reading ends at ``##FASTA``."""
    lines = spark.read.text(path).select("value", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("row")).alias("ord"))
    if strict:
        ends = lines.where(F.startswith(F.col("value"), F.lit("##FASTA"))).groupBy(F.col("ord.file_path").alias("path")).agg(F.min("ord").alias("stop"))
        lines = lines.join(ends, lines["ord.file_path"] == F.col("path"), "left").where(F.col("stop").isNull() | (F.col("ord") < F.col("stop"))).select("value", "ord")
    regions = parse_gff3(lines, strict)
    if not derive:
        return regions
    return regions.unionByName(derive_promoters(regions)).unionByName(derive_tss(regions)).select(*REGION_COLUMNS, "ord")
