"""Statements to lazy DataFrames.

A set of regions has the region columns and ``ord``, which orders it; nothing runs until a result is asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dna import to_bases
from ..functions.pssm import DEFAULT_THRESHOLD, Pssm
from ..operators import motif, pwm, regions, within
from ..operators.similarity import OPS, filter_similarity, with_similarity
from ..schema import REGION_COLUMNS
from ..semantics import Semantics
from .syntax import ENTITIES, Both, Compare, Extract, Find, Not, Scan, SetOp, compares


class Compiler:
    """``sequences``, ``annotation``, ``matrices`` and ``results`` are what has been loaded and found so far."""

    def __init__(self, semantics: Semantics, long_records: bool = True):
        self.semantics, self.long_records = semantics, long_records
        self.sequences: DataFrame | None = None
        self.annotation: DataFrame | None = None
        self.matrices: dict[str, Pssm] = {}
        self.results: dict[str, DataFrame] = {}
        #: Results that have their bases already.
        self.filled: set[str] = set()

    def resolve(self, name: str) -> DataFrame:
        if name in self.results:
            return self.results[name]
        if self.annotation is None:
            return self._no_regions()
        return regions.of_type(self.annotation, name if name in ENTITIES else name)

    def _no_regions(self) -> DataFrame:
        return self.sequences.limit(0).select(F.lit("").alias("chr"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"), *(F.lit("").alias(c) for c in REGION_COLUMNS[3:]), F.struct(F.lit(0)).alias("ord"))

    def compile(self, s) -> DataFrame:
        match s:
            case Find():
                return self._matches(s, self._find(s))
            case Scan():
                return self._matches(s, self._scan(s))
            case Extract():
                return self._named(s, self.filtered(self._with_bases(s.entity), s.where))
            case SetOp():
                return self._named(s, self.filtered(self._set(s), s.where))
        raise TypeError(s)

    def _attached(self, found: DataFrame) -> DataFrame:
        if self.sequences is None:
            return found
        return regions.attach_sequence(found, self.sequences, self.semantics.all_records, self.long_records)

    def _with_bases(self, name: str) -> DataFrame:
        return self.resolve(name) if name in self.filled else self._attached(self.resolve(name))

    def _named(self, s, found: DataFrame) -> DataFrame:
        if s.alias:
            self.results[s.alias] = found
            if self.sequences is not None:
                self.filled.add(s.alias)
        return found

    def _find(self, s: Find) -> DataFrame:
        sem = self.semantics
        sequences = self.sequences
        if s.chr is not None and sem.apply_chr:
            sequences = sequences.where(F.col("seq_id") == s.chr)
        if s.within is None:
            found = motif.find(sequences, s.pattern, s.strand, forward_context=sem.forward_context, errors=sem.regex_errors, fold_palindromes=sem.fold_palindromes, long_records=self.long_records)
            return found.withColumn("ord", F.struct("seq_id", "position", "strand", "match_length"))
        w = s.within
        targets = self.resolve(w.entity)
        if w.name is not None:
            targets = within.named(targets, w.name, sem.fallback_target)
        found = within.find_within(sequences, s.pattern, targets, to_bases(w.distance, w.unit), w.direction, s.strand, by_name=sem.all_records, long_records=self.long_records, errors=sem.regex_errors, fold_palindromes=sem.fold_palindromes)
        return found.withColumn("ord", F.struct("target", "position", "strand", "match_length")).drop("target")

    def _scan(self, s: Scan) -> DataFrame:
        threshold = DEFAULT_THRESHOLD if s.threshold is None or (s.threshold == 0 and not self.semantics.zero_threshold) else s.threshold
        found = pwm.scan(self.sequences, self.matrices[s.matrix], s.strand, threshold, scores=True, long_records=self.long_records)
        return found.withColumn("ord", F.struct("seq_id", "position", "strand", "match_length"))

    def _matches(self, s, matches: DataFrame) -> DataFrame:
        """Matches without an alias stay matches; with one they become regions with their bases."""
        if not s.alias:
            if s.where is None or not self.semantics.filter_unnamed:
                return matches
            kept = self.filtered(self._regions(matches, "match", s.where), s.where)
            place = [F.col("chr").alias("seq_id"), F.col("start").alias("position"), (F.col("end") - F.col("start")).alias("match_length"), "strand"]
            return matches.join(kept.select(*place, "ord").distinct(), ["seq_id", "position", "match_length", "strand", "ord"], "left_semi")
        all_ = self._regions(matches, s.alias)
        kept = self.filtered(all_, s.where)
        self.results[s.alias] = kept if self.semantics.alias_after_where else all_
        self.filled.add(s.alias)
        return kept

    def _regions(self, matches: DataFrame, alias: str, where=None) -> DataFrame:
        plain = [c for c in matches.columns if c != "score"]
        needs = where is None or any(c.property == "SIMILARITY" for c in compares(where))
        found = motif.as_regions(matches.select(*plain), alias)
        return self._attached(found) if needs else found

    def _set(self, s: SetOp) -> DataFrame:
        if s.op == "UNION":
            # merged rows get new bases, or keep their first member's
            fresh = self.semantics.reslice_union
            a, b = (self.resolve(x) if fresh else self._with_bases(x) for x in (s.left, s.right))
            out = regions.union(a, b).drop("n_members")
            if fresh:
                out = self._attached(out.withColumn("sequence", F.lit("")) if self.sequences is not None else out)
            return out.withColumn("ord", F.struct("chr", "start", "end", "strand", "name"))
        a, b = self._with_bases(s.left), self.resolve(s.right)
        out = regions.intersect(a, b) if s.op == "INTERSECT" else regions.except_(a, b)
        return out.withColumn("ord", F.struct("chr", "start", "end", "strand", "name", F.col("ord").alias("before")))

    # --- conditions

    def filtered(self, found: DataFrame, where) -> DataFrame:
        """A chain of ANDs is applied one by one, so that SIMILARITY refers to the first region left; under OR and
        NOT it refers to the first region of the statement, which passes."""
        if where is None:
            return found
        chain = compares(where) if not self.semantics.boolean_logic else _ands(where)
        if chain is not None:
            for c in chain:
                found = filter_similarity(found, c.op, self._number(c)) if c.property == "SIMILARITY" else found.where(self._length(c))
            return found
        needs = any(c.property == "SIMILARITY" for c in compares(where))
        scored = with_similarity(found) if needs else found
        return scored.where(self._truth(where)).select(*found.columns)

    def _number(self, c: Compare) -> float:
        return 0.0 if c.value.kind == "STRING" else float(c.value.text)

    def _length(self, c: Compare) -> Column:
        unit = c.value.unit if c.value.unit != "%" else None
        return regions.length_is(c.op, to_bases(self._number(c), unit, self.semantics.fractional_units))

    def _truth(self, condition) -> Column:
        match condition:
            case Both("AND", left, right):
                return self._truth(left) & self._truth(right)
            case Both(_, left, right):
                return self._truth(left) | self._truth(right)
            case Not(of):
                return ~self._truth(of)
            case Compare(property="SIMILARITY"):
                return F.col("is_first") | F.coalesce(OPS[condition.op](F.col("similarity"), self._number(condition)), F.lit(False))
        return self._length(condition)


def _ands(condition) -> list[Compare] | None:
    """The comparisons of a chain of ANDs; None if there is an OR or NOT."""
    match condition:
        case Compare():
            return [condition]
        case Both("AND", left, right):
            a, b = _ands(left), _ands(right)
            return None if a is None or b is None else a + b
    return None
