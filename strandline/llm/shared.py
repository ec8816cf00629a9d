"""Places that the driver and all executors share, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``, as a full URI.

    Where it is unset a local master gets a temporary folder; a cluster gets an error, since a
    machine's own disk is not visible to the other machines.
    """
    global _local_dir
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        _local_dir = _local_dir or tempfile.mkdtemp(prefix="strandline-")
        named = f"file://{_local_dir}"
    path = spark._jvm.org.apache.hadoop.fs.Path(named)
    conf = spark._jsc.hadoopConfiguration()
    full = path.getFileSystem(conf).makeQualified(path).toString()
    return full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file://") else full


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/strandline/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt anew if it comes in fewer partitions than there are cores, as from one small file; else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or the first of it with underscores added that is no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: its lineage ends at the files."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes the files of ``stored`` tables that nothing reads any more."""
    for t in tables:
        removed(t.sparkSession, t.stored_path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a path in the shared folder."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def file_system(uri: str):
    """(pyarrow file system, path) of a URI, on the driver or an executor."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)
