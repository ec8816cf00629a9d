"""Schemas of sequences, regions, matches and matrices.

Coordinates are 0-based and half-open. ``ord`` gives the order of a set: any orderable column.
"""

from pyspark.sql import types as T

SEQUENCE = T.StructType([
    T.StructField("seq_id", T.StringType()),
    T.StructField("header", T.StringType()),
    T.StructField("sequence", T.StringType()),
])

#: Columns of every set of regions, before ``ord``.
REGION = T.StructType([
    T.StructField("chr", T.StringType()),
    T.StructField("start", T.LongType()),
    T.StructField("end", T.LongType()),
    T.StructField("strand", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("sequence", T.StringType()),
])
REGION_COLUMNS = REGION.fieldNames()
