"""Connected components of links and tiles of buckets, for the near-duplicate operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import new_path, removed, stored


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(id, component) of every id in ``links`` (a, b), component being the smallest id reachable.

    Alternates large-star and small-star steps until the links no longer change. Each step's links are a
    table in the shared folder, so lineage stays short; a step reads its predecessor's alone. Minima are
    pre-aggregated, and the joins on an id are plain equi-joins that adaptive execution can split.
    """
    spark = links.sparkSession
    schema = "a bigint, b bigint"

    def write(df: DataFrame) -> tuple[str, tuple]:
        path = new_path(spark, name)
        df.write.parquet(path)
        return path, tuple(spark.read.schema(schema).parquet(path).agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    # a is the larger end throughout
    pairs = links.where("a <> b").select(F.greatest("a", "b").cast("bigint").alias("a"), F.least("a", "b").cast("bigint").alias("b")).distinct()
    path, state = write(pairs)
    while state[0]:
        now = spark.read.schema(schema).parquet(path)
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: every larger neighbour of a goes to the smallest id around a
        large = now.select(F.col("b").alias("a"), F.col("a").alias("v")).join(least, "a").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a and its smaller neighbours go to the smallest of them
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(smallest, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        new, after = write(small)
        removed(spark, path)
        done, path, state = after == state, new, after
        if done:
            break
    stars = spark.read.schema(schema).parquet(path)
    return stars.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(stars.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def tiles(rows: DataFrame, key: list[str], salt: str, block: int, least: int = 1) -> DataFrame:
    """``rows`` with columns ``tile`` and ``own``: buckets of up to ``block`` rows have the one tile 0; the rows of a larger
    one are dealt into blocks by ``salt``, and each pair of blocks is a tile, so that any two rows of a
    bucket meet in a tile of about two blocks, in whichever task it falls to.

    Tile numbers of blocks i <= j are j (j + 1) / 2 + i. ``own`` is the row's block, or -1 in the tile of a
    block with itself: pairs of a tile with two blocks are those whose ``own`` differ. Sizes are counted
    with map-side sums. Buckets of under ``least`` rows are left out.
    """
    sizes = rows.groupBy(*key).agg(F.count("*").alias("_n")).where(F.col("_n") > (block if least < 2 else least - 1))
    sizes = sizes.select(*key, F.ceil(F.col("_n") / block).cast("int").alias("_blocks"))
    with_size = rows.join(stored(sizes, "large-buckets"), key, "left" if least < 2 else "inner")  # as a table its size is known: no join by shuffle unless it is large
    own = F.pmod(F.xxhash64(salt), F.col("_blocks")).cast("int")
    other = F.explode(F.when(F.coalesce("_blocks", F.lit(1)) == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    dealt = with_size.withColumn("_own", F.coalesce(own, F.lit(0))).withColumn("_other", other)
    high, low = F.greatest("_own", "_other").cast("long"), F.least("_own", "_other").cast("long")
    dealt = dealt.withColumn("tile", (high * (high + 1) / 2).cast("long") + low)
    return dealt.withColumn("own", F.when(F.col("_own") == F.col("_other"), -1).otherwise(F.col("_own"))).drop("_blocks", "_own", "_other")


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables that end where a run of equal keys ends, from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        start = runs(*(batch.column(c).to_numpy(zero_copy_only=False) for c in keys))
        if held and len(start) == 1 and all(held[-1].column(c)[-1] == batch.column(c)[0] for c in keys):
            held.append(batch)
            continue
        cut = int(start[-1])
        if held or cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks()
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def runs(*keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys in sorted columns."""
    if not len(keys[0]):
        return np.empty(0, np.int64)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def stars(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member's position for each of n positions linked by pairs (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        new = new[new]
        if (new == label).all():
            return label
        label = new
