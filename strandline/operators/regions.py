"""Operators on regions: filters, overlap joins, merging, sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dna import cut, region_length
from ..schema import REGION_COLUMNS
from .sequences import PIECE, pieces

#: Bases of a bin. Regions meet by bins, so that one long chromosome is many tasks.
BIN = 1 << 14
#: Letters of a type whose spellings are listed.
SPELLED = 4
COMPARE = {">": lambda a, b: a > b, "<": lambda a, b: a < b, ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b, "=": lambda a, b: a == b}


def of_type(regions: DataFrame, name: str) -> DataFrame:
    """Regions of a feature type, case aside. The spellings of a short name are a list that reaches the scan; any other
    name's usual ones cannot be told from rarer spellings, so it is compared in lower case."""
    spellings = [""]
    for c in name if sum(x.isalpha() for x in name) <= SPELLED else "":
        spellings = [s + x for s in spellings for x in dict.fromkeys((c.lower(), c.upper()))]
    if name.isascii() and len(spellings) > 1 and "k" not in name.lower():  # the Kelvin sign is a k in lower case
        return regions.where(F.col("type").isin(spellings))
    return regions.where(F.lower("type") == name.lower())


def length_is(op: str, bases: float) -> Column:
    return COMPARE[op](region_length(), F.lit(int(bases) if float(bases).is_integer() else float(bases)))


def filter_length(regions: DataFrame, op: str, bases: float) -> DataFrame:
    return regions.where(length_is(op, bases))


def _bins(size: int) -> Column:
    """Bins that a region lies in; one for an empty region."""
    return F.sequence(F.floor(F.col("start") / size), F.floor(F.greatest(F.col("end") - 1, F.col("start")) / size))


def _one_bin(size: int) -> Column:
    return F.floor(F.col("start") / size) == F.floor(F.greatest(F.col("end") - 1, F.col("start")) / size)


def _overlap_join(a: DataFrame, b: DataFrame, keep: bool, size: int) -> DataFrame:
    """Rows of ``a`` with (``keep``) or without an overlap in ``b``.

    Rows within one bin are decided there, by a semi or anti join on (chr, bin). Of rows over several bins the
    distinct spans are spread over their bins, and rows are then decided by their span. An empty region that
    begins a bin may lie inside one that ends in it, and is put into the bin before too.

    Of the regions of ``b`` that begin at one place the longest decides, and where a bin is entered from before it does
    not matter how far before, so ``b`` is at most size + 1 rows a bin, aggregated before the shuffle.
    """
    spread = b.select(F.col("chr").alias("b_chr"), "start", F.col("end").alias("b_end"), F.explode(_bins(size)).alias("b_bin"))
    begins = F.greatest(F.col("start"), F.col("b_bin") * size - 1).alias("b_start")
    spans = spread.groupBy("b_chr", "b_bin", begins).agg(F.max("b_end").alias("b_end"))
    meets = (F.col("chr") == F.col("b_chr")) & (F.col("bin") == F.col("b_bin")) & (F.col("start") < F.col("b_end")) & (F.col("end") > F.col("b_start"))
    one = _one_bin(size) & (F.col("start") < F.col("end"))
    how = "left_semi" if keep else "left_anti"
    within = a.where(one).withColumn("bin", F.floor(F.col("start") / size)).join(spans, meets, how).drop("bin")
    wide = a.where(~one)
    low = F.floor(F.greatest(F.col("start") - F.when(F.col("start") < F.col("end"), 0).otherwise(1), F.lit(0)) / size)
    across = F.sequence(low, F.floor(F.greatest(F.col("end") - 1, F.col("start")) / size))
    hit = wide.select("chr", "start", "end").distinct().withColumn("bin", F.explode(across)).join(spans, meets, "left_semi").select("chr", "start", "end").distinct()
    return within.unionByName(wide.join(hit, ["chr", "start", "end"], how).select(*a.columns))


def intersect(a: DataFrame, b: DataFrame, size: int = BIN) -> DataFrame:
    """Whole rows of ``a`` that overlap some row of ``b``; their type names that of b's first row too."""
    first = b.agg(F.min(F.struct("chr", "start", "end", "strand", "name", "type")).alias("first"))  # one row
    label = first.select(F.col("first.type").alias("_with"))
    out = _overlap_join(a, b, True, size).join(F.broadcast(label))
    return out.withColumn("type", F.concat("type", F.lit(" ∩ "), "_with")).drop("_with")


def except_(a: DataFrame, b: DataFrame, size: int = BIN) -> DataFrame:
    """Whole rows of ``a`` that overlap no row of ``b``."""
    return _overlap_join(a, b, False, size)


def union(a: DataFrame, b: DataFrame | None = None, size: int = BIN) -> DataFrame:
    """Rows of both, merged where they overlap or touch, strands aside: region columns and ``n_members``.

    A merged row has the strand, name and sequence of its first member and type ``union``. Rows are swept bin by
    bin; what reaches over from earlier bins comes from running maxima over the bins of each chromosome, so
    no task sweeps a whole one.
    """
    rows = a.select(*REGION_COLUMNS) if b is None else a.select(*REGION_COLUMNS).unionByName(b.select(*REGION_COLUMNS))
    rows = rows.withColumn("_bin", F.floor(F.col("start") / size))
    order = Window.partitionBy("chr", "_bin").orderBy("start", "end", "strand", "name", "type", "sequence")
    rows = rows.withColumn("_inside", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    earlier = Window.partitionBy("chr").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)  # a row for each bin
    reach = rows.groupBy("chr", "_bin").agg(F.max("end").alias("_end")).withColumn("_reach", F.max("_end").over(earlier)).select(F.col("chr").alias("_c"), F.col("_bin").alias("_b"), "_reach")
    same = F.col("chr").eqNullSafe(F.col("_c")) & (F.col("_bin") == F.col("_b"))
    rows = rows.join(reach, same).drop("_c", "_b")
    before = F.greatest("_inside", "_reach")  # ignores nulls
    rows = rows.withColumn("_new", F.when(before.isNull() | (F.col("start") > before), F.col("start")))
    again = Window.partitionBy("chr", "_bin").orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_own", F.max("_new").over(again))
    opened = rows.groupBy("chr", "_bin").agg(F.max("_new").alias("_last")).withColumn("_open", F.max("_last").over(earlier)).select(F.col("chr").alias("_c"), F.col("_bin").alias("_b"), "_open")
    rows = rows.join(opened, same).drop("_c", "_b")
    key = F.struct("start", "end", "strand", "name", "type", "sequence")
    merged = rows.withColumn("_island", F.coalesce("_own", "_open")).groupBy("chr", "_island").agg(F.min(key).alias("f"), F.max("end").alias("end"), F.count("*").alias("n_members"))
    return merged.select("chr", "f.start", "end", "f.strand", F.when(F.col("n_members") > 1, F.lit("union")).otherwise(F.col("f.type")).alias("type"), "f.name", "f.sequence", "n_members")


def attach_sequence(regions: DataFrame, sequences: DataFrame, by_name: bool = True, long_records: bool = False) -> DataFrame:
    """Regions with their forward bases where they have none yet and lie within the sequence.

    With ``long_records`` sequences are cut into pieces, each distinct span gathers its bases from the pieces it
    touches, and rows join their span, so no row carries a whole sequence. Without ``by_name`` all regions lie on
    the one sequence given.
    """
    if long_records and by_name:
        return _attach_pieces(regions, sequences)
    seqs = sequences.select(F.col("seq_id").alias("_id"), F.col("sequence").alias("_bases"))
    joined = regions.join(seqs, F.col("chr") == F.col("_id"), "left") if by_name else regions.join(F.broadcast(seqs.limit(1)), F.lit(True), "left")
    size = F.length("_bases")
    fits = ((F.col("sequence") == "") | F.col("sequence").isNull()) & (F.col("start") < size) & (F.col("end") <= size)
    new = F.when(fits, cut(F.col("_bases"), F.col("start"), F.col("end"))).otherwise(F.coalesce("sequence", F.lit("")))
    return joined.withColumn("sequence", new).select(*regions.columns)


def _attach_pieces(regions: DataFrame, sequences: DataFrame) -> DataFrame:
    pieces_ = pieces(sequences, 0, 0).select(F.col("seq_id").alias("_id"), "offset", "piece")
    spans = regions.where((F.coalesce("sequence", F.lit("")) == "") & (F.col("start") < F.col("end"))).select("chr", "start", "end").distinct()
    touched = F.transform(F.sequence(F.floor(F.col("start") / PIECE), F.floor((F.col("end") - 1) / PIECE)), lambda k: k * PIECE)
    parts = spans.withColumn("_offset", F.explode(touched)).join(pieces_, (F.col("chr") == F.col("_id")) & (F.col("_offset") == F.col("offset")))
    low, high = F.greatest(F.col("start") - F.col("offset"), F.lit(0)), F.least(F.col("end") - F.col("offset"), F.lit(PIECE))
    parts = parts.withColumn("part", F.struct("offset", cut(F.col("piece"), low, high).alias("bases")))
    bases = parts.groupBy("chr", "start", "end").agg(F.sort_array(F.collect_list("part")).alias("parts"))  # a span's own bases
    found = bases.select(F.col("chr").alias("_c"), F.col("start").alias("_s"), F.col("end").alias("_e"), F.array_join("parts.bases", "").alias("_bases"))
    found = found.where(F.length("_bases") == F.col("_e") - F.col("_s"))  # the span lies within its sequence
    joined = regions.join(found, (F.col("chr") == F.col("_c")) & (F.col("start") == F.col("_s")) & (F.col("end") == F.col("_e")), "left")
    own = F.coalesce("sequence", F.lit(""))
    return joined.withColumn("sequence", F.when(own == "", F.coalesce("_bases", F.lit(""))).otherwise(own)).select(*regions.columns)


def type_counts(regions: DataFrame) -> DataFrame:
    return regions.groupBy("type").agg(F.count("*").alias("n"))


def top(regions: DataFrame, n: int, *order: str) -> DataFrame:
    return regions.orderBy(*order).limit(n)

