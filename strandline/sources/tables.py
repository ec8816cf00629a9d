"""Tables in the folder that the cluster's machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str | None:
    """``spark.checkpoint.dir``; on a local master without it a temporary folder, on a cluster without it none."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    return f"file://{tempfile.gettempdir()}/strandline-queries" if spark.sparkContext.master.startswith("local[") else None


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table that is computed once; ``df`` itself where no folder is shared. The table stays until the folder is cleaned."""
    folder = shared_folder(df.sparkSession)
    if folder is None:
        return df
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
