"""Motif search: literal patterns and regular expressions, on both strands.

Matches are (seq_id, position, match_length, strand, context); positions are 0-based on the forward strand.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dna import CONTEXT, context, revcomp
from .sequences import pieces, spread, whole

#: Characters that make a pattern a regular expression.
SPECIAL = set("[]()|*+?.{}^$")
_POSIX = {"alpha": "a-zA-Z", "digit": "0-9", "alnum": "a-zA-Z0-9", "upper": "A-Z", "lower": "a-z", "space": r"\s", "punct": r"!-/:-@\[-`{-~", "word": r"\w"}


class PatternError(ValueError):
    """A regular expression that cannot be used."""


def is_regex(pattern: str) -> bool:
    return bool(SPECIAL & set(pattern))


def compiled(pattern: str) -> re.Pattern:
    """A pattern of the ECMAScript kind: constructs that it lacks are errors, its character classes are translated."""
    if re.search(r"\(\?<|\(\?P|\(\?[aiLmsux-]+[):]|\\[AZ]|\(\?#|\(\?\(", pattern):
        raise PatternError(f"not part of the pattern language: {pattern!r}")
    translated = re.sub(r"\[:(\w+):\]", lambda m: _POSIX.get(m[1], m[0]), pattern)
    try:
        return re.compile(translated, re.IGNORECASE)
    except re.error as e:
        raise PatternError(f"{pattern!r}: {e}") from e


def _strands(strand: str | None) -> tuple[bool, bool]:
    return strand in (None, "+"), strand in (None, "-")


def _positions(pattern: str) -> Column:
    """Starts of a literal in a piece, overlapping ones too, as an array.

    A split before each occurrence gives segments whose lengths add up to its starts; the first segment begins
    an occurrence only if the piece does.
    """
    parts = F.split("piece", "(?=" + re.escape(pattern) + ")", -1)
    walk = F.aggregate(
        parts,
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("found")),
        lambda s, x: F.struct((s["at"] + F.length(x)).alias("at"), F.when((s["at"] > 0) | F.startswith(F.col("piece"), F.lit(pattern)), F.array_append(s["found"], s["at"])).otherwise(s["found"]).alias("found")),
    )
    return F.filter(walk["found"], lambda p: (p >= F.col("lead")) & (p < F.col("lead") + F.col("core")))


def find_literal(sequences: DataFrame, pattern: str, strand: str | None = None, around: int = CONTEXT, long_records: bool = False, fold_palindromes: bool = True) -> DataFrame:
    """All occurrences of a literal, case aside. Hits of the minus strand are those of the reverse complement,
    which a palindrome does not have apart from its own.

    Column functions only, and no shuffle; with ``long_records`` sequences are cut into pieces first, which are dealt
    anew if there are fewer partitions than cores.
    """
    folded = pattern.upper()
    plus, minus = _strands(strand)
    other = revcomp(folded)
    palindrome = other == (folded if fold_palindromes else pattern)
    m = len(folded)
    words = ([("+", folded)] if plus else []) + ([("-", other)] if minus and not palindrome else [])
    if not m or not words:
        return _no_matches(sequences)
    base = sequences.select("seq_id", F.upper("sequence").alias("sequence"))
    cut_up = spread(pieces(base, around, m - 1 + around)) if long_records else whole(base)
    hits = []
    for sign, word in words:
        found = F.transform(_positions(word), lambda p: F.struct((F.col("offset") + p - F.col("lead")).alias("position"), context(F.col("piece"), p, F.lit(m), around).alias("context")))
        rows = cut_up.select("seq_id", F.explode(found).alias("hit"))
        hits.append(rows.select("seq_id", "hit.position", F.lit(m).cast("long").alias("match_length"), F.lit(sign).alias("strand"), "hit.context"))
    return hits[0] if len(hits) == 1 else hits[0].unionByName(hits[1])


def _no_matches(sequences: DataFrame) -> DataFrame:
    return sequences.sparkSession.createDataFrame([], "seq_id string, position long, match_length long, strand string, context string")


def find_regex(sequences: DataFrame, pattern: str, strand: str | None = None, around: int = CONTEXT, forward_context: bool = True, errors: bool = True) -> DataFrame:
    """Leftmost non-overlapping matches, empty ones too; on the minus strand those of the reverse complement.

    A match may be of any length, so a record is searched as a whole, in Arrow batches.
    """
    try:
        compiled(pattern)
    except PatternError:
        if errors:
            raise
        return _no_matches(sequences)
    plus, minus = _strands(strand)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        regex = compiled(pattern)
        for batch in batches:
            names, at, size, sign, near = [], [], [], [], []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = text or ""
                for mark in "+" * plus + "-" * minus:
                    shown = text if mark == "+" else revcomp(text)
                    for hit in regex.finditer(shown):
                        a, b = hit.span()
                        p = a if mark == "+" else len(text) - b
                        names.append(name)
                        at.append(p)
                        size.append(b - a)
                        sign.append(mark)
                        near.append(text[max(p - around, 0) : p + b - a + around] if forward_context else shown[max(a - around, 0) : b + around])
            yield pa.RecordBatch.from_pydict({"seq_id": pa.array(names, pa.string()), "position": pa.array(at, pa.int64()), "match_length": pa.array(size, pa.int64()), "strand": pa.array(sign, pa.string()), "context": pa.array(near, pa.string())})

    return sequences.select(F.col("seq_id").cast("string"), "sequence").mapInArrow(run, "seq_id string, position long, match_length long, strand string, context string")


def find(sequences: DataFrame, pattern: str, strand: str | None = None, seq_id: str | None = None, **options) -> DataFrame:
    """Literal or regular-expression search, as the pattern asks for; ``seq_id`` restricts it to one sequence."""
    if seq_id is not None:
        sequences = sequences.where(F.col("seq_id") == seq_id)
    names = ("around", "forward_context", "errors") if is_regex(pattern) else ("around", "long_records", "fold_palindromes")
    chosen = {k: v for k, v in options.items() if k in names}
    return (find_regex if is_regex(pattern) else find_literal)(sequences, pattern, strand, **chosen)


def as_regions(matches: DataFrame, alias: str, sequences: DataFrame | None = None, long_records: bool = False) -> DataFrame:
    """Matches as regions named alias_position of type alias; with ``sequences`` their forward bases too."""
    out = matches.select(
        F.col("seq_id").alias("chr"), F.col("position").alias("start"), (F.col("position") + F.col("match_length")).alias("end"), "strand",
        F.lit(alias).alias("type"), F.concat(F.lit(f"{alias}_"), F.col("position").cast("string")).alias("name"), F.lit("").alias("sequence"), *[c for c in matches.columns if c == "ord"],
    )
    if sequences is None:
        return out
    from .regions import attach_sequence

    return attach_sequence(out, sequences, long_records=long_records)
