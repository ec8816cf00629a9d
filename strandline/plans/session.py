"""Sessions run scripts against files and registered tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pssm import Pssm, Pwm, pssm
from ..semantics import DOCUMENTED, PROFILES, Semantics
from ..sources.fasta import read_fasta
from ..sources.gff3 import read_gff3
from ..sources.jaspar import read_jaspar
from ..sources.tables import written
from .analysis import ANNOTATION, MATRIX, RESULT, SEQUENCES, analyze
from .compiler import Compiler
from .errors import SemanticError
from .syntax import Find, Load, Scan, SetOp, parse

SHOWN, BASES_SHOWN = 20, 60


@dataclass(frozen=True)
class Result:
    """What a statement found: regions, or the matches of a FIND or SCAN without an alias."""

    statement: object
    frame: DataFrame
    kind: str  # regions or matches

    def text(self) -> str:
        """The number of rows and the first of them, in the set's order."""
        n = self.frame.count()
        if not n:
            return f"  No {'regions' if self.kind == 'regions' else 'matches'} found."
        rows = self.frame.orderBy("ord").limit(SHOWN).collect()
        lines = [f"  Found {n} {'region(s)' if self.kind == 'regions' else 'match(es)'}:"]
        for k, r in enumerate(rows, 1):
            if self.kind == "matches":
                lines.append(f"  [{k}] pos:{r.position}  strand:{r.strand}  context: ...{r.context}...")
                continue
            lines.append(f"  [{k}] {r.chr}:{r.start}..{r.end}  length:{r.end - r.start} BP  strand:{r.strand}  type:{r.type}" + (f"  name:{r.name}" if r.name else ""))
            if r.sequence:
                lines.append("      seq: " + r.sequence[:BASES_SHOWN] + "..." * (len(r.sequence) > BASES_SHOWN))
        if n > SHOWN:
            lines.append(f"  ... and {n - SHOWN} more.")
        return "\n".join(lines)


class Session:
    """Names stay from script to script. ``profile`` is ``documented``, ``observed`` or a Semantics."""

    def __init__(self, spark: SparkSession, profile: str | Semantics = DOCUMENTED, long_records: bool = True):
        self.spark = spark
        self.semantics = PROFILES[profile] if isinstance(profile, str) else profile
        self.kinds: dict[str, str] = {}
        self.compiler = Compiler(self.semantics, long_records)

    def _exists(self, path: str) -> bool:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return bool(target.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(target))

    # --- tables that come from elsewhere than files

    def register_sequences(self, alias: str, frame: DataFrame) -> None:
        """(seq_id, sequence); the sequences that FIND and SCAN search from now on."""
        self.kinds[alias] = SEQUENCES
        self.compiler.sequences = frame if self.semantics.all_records else frame.limit(1)

    def register_annotation(self, alias: str, frame: DataFrame) -> None:
        """Regions with ``ord``."""
        self.kinds[alias] = ANNOTATION
        self.compiler.annotation = frame

    def register_matrix(self, alias: str, matrix: Pwm | Pssm) -> None:
        self.kinds[alias] = MATRIX
        self.compiler.matrices[alias] = pssm(matrix) if isinstance(matrix, Pwm) else matrix

    def register_regions(self, alias: str, frame: DataFrame) -> None:
        """A set of regions with ``ord`` that statements can name."""
        self.kinds[alias] = RESULT
        self.compiler.results[alias] = frame

    def table(self, alias: str) -> DataFrame:
        return self.compiler.results[alias]

    # ---

    def run(self, script: str) -> list[Result]:
        """Results of all statements but LOADs. Checks come first: a script with an error runs nothing.

        A set that a later set operation of the script names is written to the shared folder, since such an operation
        reads its sets more than once and chains of them would search again for each; all else is lazy.
        """
        statements = parse(script)
        kinds = analyze(statements, self.kinds, self.semantics, self._exists)
        out = []
        for k, s in enumerate(statements):
            if isinstance(s, Load):
                self._load(s)
                continue
            frame = self.compiler.compile(s)
            if s.alias in {name for x in statements[k + 1 :] if isinstance(x, SetOp) for name in (x.left, x.right)}:
                frame = self._once(s.alias, frame)
            matches = isinstance(s, Find | Scan) and not s.alias
            out.append(Result(s, frame, "matches" if matches else "regions"))
        self.kinds = kinds
        return out

    def _once(self, alias: str, frame: DataFrame) -> DataFrame:
        """Writes the set; ``frame``, or the table if both are the same set."""
        whole = self.compiler.results[alias]
        self.compiler.results[alias] = written(whole, "set")
        return self.compiler.results[alias] if frame is whole else frame

    def _load(self, s: Load) -> None:
        if s.kind == "SEQUENCE":
            self.register_sequences(s.alias, read_fasta(self.spark, s.path, first_only=not self.semantics.all_records))
        elif s.kind == "ANNOTATION":
            self.register_annotation(s.alias, read_gff3(self.spark, s.path, self.semantics.strict_gff))
        else:
            self.register_matrix(s.alias, read_jaspar(self.spark, s.path))

    def describe(self, script: str, results: list[Result] | None = None) -> str:
        """Tokens, statements, checks and names of a script, the plan of each of ``results``, and the number of features of each type."""
        from .syntax import tokenize

        lines = ["tokens: " + " ".join(t.text for t in tokenize(script)[:-1])]
        statements = parse(script)
        lines += [f"statement: {s}" for s in statements]
        try:
            analyze(statements, self.kinds, self.semantics, self._exists)
            lines.append("checks: passed")
        except SemanticError as e:
            lines.append(f"checks: {e}")
        for k, r in enumerate(results or [], 1):
            lines.append(f"plan of result {k}:")
            lines += ["  " + x for x in r.frame._jdf.queryExecution().simpleString().splitlines() if x.strip()]
        lines += [f"name: {k} ({v})" for k, v in sorted(self.kinds.items())]
        if self.compiler.annotation is not None:
            counts = self.compiler.annotation.groupBy("type").agg(F.count("*").alias("n")).orderBy("type").collect()
            lines += [f"features: {r.type} {r.n}" for r in counts]
        return "\n".join(lines)


