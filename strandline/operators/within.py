"""Motif search in windows before or after features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dna import CONTEXT, context
from .motif import compiled, find_literal, find_regex, is_regex
from .regions import BIN, attach_sequence


def windows(targets: DataFrame, sequences: DataFrame, distance: float, direction: str, by_name: bool = True) -> DataFrame:
    """``targets`` with seq_id, its length n, ws and we: the ``distance`` bases up- or downstream of each, within its sequence.

    Features of the plus strand or none have their upstream side before the start, all others after the end.
    """
    sizes = sequences.select(F.col("seq_id").cast("string").alias("seq_id"), F.length("sequence").cast("long").alias("_n"))
    joined = targets.join(sizes, F.col("chr") == F.col("seq_id")) if by_name else targets.join(F.broadcast(sizes.limit(1)))
    forward = F.coalesce(F.col("strand"), F.lit("")).isin("+", "")
    d = int(distance)
    before = forward if direction.upper() == "UPSTREAM" else ~forward
    ws = F.when(before, F.greatest(F.col("start") - d, F.lit(0))).otherwise(F.col("end"))
    we = F.when(before, F.col("start")).otherwise(F.least(F.col("end") + d, F.col("_n")))
    out = joined.withColumn("ws", ws).withColumn("we", F.least(we, F.col("_n"))).withColumnRenamed("_n", "n")
    return out.where(F.col("ws") < F.col("we"))


def named(targets: DataFrame, name: str, fallback: bool = True) -> DataFrame:
    """Targets of a name; if there is none and ``fallback`` holds, all of them."""
    mine = targets.where(F.col("name") == name)
    if not fallback:
        return mine
    some = mine.select(F.lit(1).alias("_some")).limit(1)  # one row at most
    return targets.join(F.broadcast(some), F.lit(True), "left").where((F.col("name") == name) | F.col("_some").isNull()).drop("_some")


def find_within(sequences: DataFrame, pattern: str, targets: DataFrame, distance: float, direction: str, strand: str | None = None, around: int = CONTEXT, by_name: bool = True, long_records: bool = False, size: int = BIN, errors: bool = True, fold_palindromes: bool = True) -> DataFrame:
    """Matches that lie fully inside a target's window: a row for each target and match, with ``target`` (its ord, if any).

    Literals are searched once and joined with the windows by bins; regular expressions see each window on its own.
    """
    keep = [F.col("ord").alias("target")] if "ord" in targets.columns else []
    spans = windows(targets, sequences, distance, direction, by_name)
    if not is_regex(pattern):
        hits = find_literal(sequences, pattern, strand, around, long_records, fold_palindromes).withColumnRenamed("seq_id", "hit_id")
        spread = spans.select("seq_id", "ws", "we", *keep, F.explode(F.sequence(F.floor(F.col("ws") / size), F.floor((F.col("we") - 1) / size))).alias("bin"))
        hits = hits.withColumn("hit_bin", F.floor(F.col("position") / size))
        inside = (F.col("hit_id") == F.col("seq_id")) & (F.col("hit_bin") == F.col("bin")) & (F.col("position") >= F.col("ws")) & (F.col("position") + F.col("match_length") <= F.col("we"))
        return hits.join(spread, inside).select("seq_id", "position", "match_length", "strand", "context", *["target"] * bool(keep))
    if errors:
        compiled(pattern)
    # a window with its surroundings is a short record of its own, named by where it lies
    low, high = F.greatest(F.col("ws") - around, F.lit(0).cast("long")), F.least(F.col("we") + around, F.col("n"))
    wide = spans.select(F.col("seq_id").alias("chr"), low.alias("start"), high.alias("end"), F.lit("").alias("sequence"), "ws", "we", *keep)
    named_ = F.to_json(F.struct("chr", "ws", "we"))
    cut = attach_sequence(wide, sequences.select(F.col("seq_id").cast("string").alias("seq_id"), F.upper("sequence").alias("sequence")), True, long_records).withColumn("name", named_)
    inner = F.substring("sequence", (F.col("ws") - F.col("start")).cast("int") + 1, (F.col("we") - F.col("ws")).cast("int"))
    found = find_regex(cut.select(F.col("name").alias("seq_id"), inner.alias("sequence")).distinct(), pattern, strand, around, errors=errors)
    joined = found.select(F.col("seq_id").alias("found"), "position", "match_length", "strand").join(cut, F.col("found") == F.col("name"))
    lead = F.col("ws") - F.col("start")
    near = context(F.col("sequence"), lead + F.col("position"), F.col("match_length"), around)
    return joined.select(F.col("chr").alias("seq_id"), (F.col("ws") + F.col("position")).alias("position"), "match_length", "strand", near.alias("context"), *["target"] * bool(keep))
