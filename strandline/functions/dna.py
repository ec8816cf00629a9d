"""Column functions on bases and coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CONTEXT = 20
#: Bases in a unit of distance.
UNITS = {"BP": 1, "KB": 1000, "MB": 1_000_000}

_TO = str.maketrans("ACGTacgt", "TGCATGCA")


def revcomp(text: str) -> str:
    """Reverse complement; what is not a base becomes N."""
    return "".join(c.translate(_TO) if c in "ACGTacgt" else "N" for c in reversed(text))


def reverse_complement(sequence: Column) -> Column:
    """``revcomp`` of a column."""
    return F.reverse(F.translate(F.regexp_replace(F.upper(sequence), "[^ACGT]", "N"), "ACGT", "TGCA"))


def region_length() -> Column:
    return F.col("end") - F.col("start")


def context(sequence: Column, position: Column, length: Column, around: int = CONTEXT) -> Column:
    """Bases from ``around`` before a match to ``around`` after it."""
    low = F.greatest(position - around, F.lit(0))
    return F.substring(sequence, (low + 1).cast("int"), (position + length + around - low).cast("int"))


def cut(sequence: Column, start: Column, end: Column) -> Column:
    return F.substring(sequence, (start + 1).cast("int"), (end - start).cast("int"))


def to_bases(value: float, unit: str | None, fractional: bool = True) -> float:
    """Bases in ``value`` units; % and no unit count as bases."""
    return (value if fractional else int(value)) * UNITS.get(unit or "BP", 1)
