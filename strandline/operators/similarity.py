"""Filter by local alignment with a set's first region."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.alignment import similarity_of

OPS = {">": lambda s, v: s > v, "<": lambda s, v: s < v, ">=": lambda s, v: s >= v, "<=": lambda s, v: s <= v, "=": lambda s, v: F.abs(s - v) <= 0.5}


def with_similarity(regions: DataFrame, reference: DataFrame | None = None, order: str = "ord") -> DataFrame:
    """Regions with ``similarity`` to the first row of ``reference`` (or of themselves) and ``is_first``.

    Rows that tie by ``order`` are told apart by their other columns; exact repeats of the first row count as first too.
    Rows without bases have no similarity.
    """
    given = regions if reference is None else reference
    whole = F.struct(order, *sorted(c for c in given.columns if c != order))
    first = given.select(F.min(whole).alias("_first")).where(F.col("_first").isNotNull())
    both = regions.join(F.broadcast(first))  # one row
    # an alignment is long work for a small row: as many tasks as the session's shuffles have, however few the bytes
    both = both.repartition(int(regions.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    some = F.coalesce("sequence", F.lit("")) != ""
    aligned = similarity_of(F.coalesce(F.upper("_first.sequence"), F.lit("")), F.upper(F.coalesce("sequence", F.lit(""))))
    is_first = F.struct(*(F.col(f"`{c}`") for c in [order, *sorted(c for c in given.columns if c != order)])).eqNullSafe(F.col("_first")) if set(given.columns) <= set(regions.columns) else F.lit(False)
    return both.select(*regions.columns, F.when(some, aligned).alias("similarity"), is_first.alias("is_first"))


def filter_similarity(regions: DataFrame, op: str, value: float, order: str = "ord") -> DataFrame:
    """The first region always stays; others do if their similarity in percent passes (= means within 0.5)."""
    scored = with_similarity(regions, order=order)
    passes = F.col("is_first") | F.coalesce(OPS[op](F.col("similarity"), value), F.lit(False))
    return scored.where(passes).drop("similarity", "is_first")
