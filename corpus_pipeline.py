"""A training corpus from raw documents: quality, line dedup, near-dedup, packing.

Each stage takes (spark, docs, sf_dir), docs having the columns of ``documents``, and works on all that its
predecessor kept. ``run`` writes each stage's result as Parquet in the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import line_dedup, packing, quality, simhash
from strandline.llm.shared import free_name, stored

#: A document whose score is below this goes.
LEAST_QUALITY = 0.3
#: SimHash of 5-word shingles in 8 lanes (512 bits). Two texts with Jaccard similarity 0.8 share 0.889 of
#: cosine and so differ in 0.152 of all bits on average, 78 of 512; 86 is one standard deviation more.
#: Of 32 segments of 16 bits such texts share one or more with a probability of 0.91, nearer ones sooner.
NEAR = {"words": 5, "lanes": 8, "most": 86, "m": 32, "slack": 1.0}
#: Texts are near copies if their sets of shingles have this Jaccard similarity; fingerprints only nominate them.
LEAST_SIMILAR = 0.8
SEQUENCE = 1024


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line CRF, trained on the labelled ones, does not reject.

    Null and empty texts are scored as one empty line, long ones whole; repeated rows share their fate, ties at the
    threshold stay; an empty table gives an empty one. All columns are kept, whatever their names.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    names = [f"c{k}" for k in range(len(docs.columns))]  # so that no column is called score
    scored = quality.score(docs.toDF(*names), quality.fit(docs, labels), text=names[docs.columns.index("text")])
    return scored.where(F.col("score") >= LEAST_QUALITY).select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are equal or nearly equal to an earlier one go; so does a document that has only empty ones left.

    Null and empty texts stay; long lines are compared whole; of ties the first by id, hash of text and place stays; rows
    that repeat an id and its text go but for one, unless all their lines are empty. An empty table gives an empty
    one. All columns are kept, whatever their names; n_chars is set anew where there is one.
    """
    own = docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text"))).alias("row")) if len(docs.columns) > 2 else docs
    done = line_dedup.dedup(own)
    done = done.where((F.col("n_kept") == F.col("n_lines")) | (F.regexp_replace("text", "\n", "") != ""))
    new = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return done.select(*((new[c] if c in new else F.col("row").getField(c)).alias(c) for c in docs.columns))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays; rows that repeat an id and its text are one.

    Null, empty and wordless texts are one group; long texts are compared whole. Of rows with the same id those of other
    texts go with it. An empty table gives an empty one. All columns are kept, whatever their names.
    """
    found = simhash.similar_documents(docs, LEAST_SIMILAR, **NEAR)
    found = stored(found.select("doc_id", (~F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("copy")), "near-copies")
    other = free_name(docs, "copy_id")
    copies = stored(found.where("copy").select(F.col("doc_id").alias(other)).distinct(), "copies")
    repeated = stored(found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias(other)), "repeated-ids")
    same = F.col("doc_id").eqNullSafe(F.col(other))
    kept = docs.join(copies, same, "left_anti")
    once = kept.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(repeated, same, "left_anti").unionByName(once)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence.

    A null or empty text is its end id alone, a long one is cut, repeated rows are packed each; an empty table gives an
    empty one. Other columns than id and text are not read.
    """
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), size=SEQUENCE, end_id=2)


STAGES = [("quality", by_quality), ("line_dedup", without_repeated_lines), ("near_dedup", without_near_copies), ("packing", packed)]
#: The stages are tested against brute-force versions: neither the CRF nor SimHash can be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs
