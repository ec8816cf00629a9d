"""JASPAR matrices. A matrix is a few lines, so it is read on the driver."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

from ..functions.pssm import BASES, Pwm

#: What a number may begin with; the rest of a token is ignored.
NUMBER = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?")


def parse_jaspar(text: str, source: str = "matrix") -> Pwm:
    """Raises ValueError where rows are missing or differ in length."""
    rows: dict[int, tuple[float, ...]] = {}
    identifier = name = ""
    seen = 0
    for line in map(str.strip, text.splitlines()):
        if not line:
            continue
        if line[0] == ">":
            words = line[1:].split()
            identifier = words[0] if words else ""
            name = words[1] if len(words) > 1 else identifier
            continue
        letter = next((c.upper() for c in line if c.isalpha()), "")
        place = BASES.find(letter) if letter and letter in BASES else seen
        tokens = re.sub(r"[\[\]<>]", " ", line).split()
        values = tuple(float(m[0]) for t in tokens if t.upper() not in tuple(BASES) and (m := NUMBER.match(t)))
        if values:
            if place > 3:
                raise ValueError(f"{source}: more than four rows")
            rows[place] = values
            seen += 1
    if seen < 4 or len(rows) < 4:
        raise ValueError(f"{source}: a matrix needs a row for each of A, C, G and T")
    if len({*map(len, rows.values())}) > 1:
        raise ValueError(f"{source}: rows differ in length")
    return Pwm(identifier, name or source, tuple(rows[k] for k in range(4)))


def read_jaspar(spark: SparkSession, path: str) -> Pwm:
    rows = spark.read.text(path, wholetext=True).limit(1).collect()
    return parse_jaspar(rows[0].value if rows else "", path)
