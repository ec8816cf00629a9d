"""URL filters: the longest rule (host and path prefix) that fits a URL judges it.

Method: a sort-merge range join. A host's labels in reverse are its canonical key, so a rule's host is a prefix of the
keys of its subdomains, that is, an interval in their order, and intervals are nested or apart. One sorted sweep goes over the
hosts of rules and the distinct hosts of URLs. It keeps a stack with a place for each number of labels: a host of
rules that begins is pushed to its place, and what it and its like no longer hold is popped, since a place counts
only while its key is a prefix of the URL's. The sweep runs in ranges of keys side by side; the stack at the border of a
range is carried in from the ranges before. What is then on a host's stack judges its URLs: of each rule host the longest
fitting path, of those the longest rule.

A common host is one row of the sweep. A rule host with more than ``few`` paths is on the stack without them; the distinct
URLs under it look their prefixes of its rules' lengths up by a join. DataFrame functions only.

Null urls and urls without ``://`` have an empty host and path and match no rule. Long urls are judged whole. Repeated rows are
judged each; an empty table of pages or rules is fine; columns of pages with the names of results are
replaced, others are kept whatever their names. Of rules with the same host and path, block wins (ties); of fitting
rules of the same length the one with the longer host does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import free_name, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
RESULTS = ["host", "path", "rule", "verdict"]
#: A host with more rules than this has its paths probed by a join.
FEW = 64


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def key_of(host: Column) -> Column:
    """Canonical key: labels from the last to the first, each with a full stop behind it."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def active_hosts(hosts: DataFrame, nodes: DataFrame, depth: int) -> DataFrame:
    """(host, stack) of ``hosts`` (host) under one or more rule hosts of ``nodes`` (host, entries): the stack has those."""
    spark = hosts.sparkSession
    begin = nodes.select(key_of(F.col("host")).alias("key"), F.size(F.split("host", r"\.")).alias("depth"), F.struct(key_of(F.col("host")).alias("key"), "host", "entries").alias("node"), F.lit(None).cast("string").alias("host"))
    asked = hosts.select(key_of(F.col("host")).alias("key"), F.lit(None).cast("int").alias("depth"), F.lit(None).cast(begin.schema["node"].dataType).alias("node"), "host")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a table, since its ranges are numbered by the partitions that wrote them
    events = stored(begin.unionByName(asked).repartitionByRange(parts, "key").withColumn("range", F.spark_partition_id()), "url-hosts")
    places = range(1, depth + 1)

    def place(d: int) -> Column:
        return F.when(F.col("depth") == d, F.col("node"))

    ends = events.select("range").distinct().join(events.where("depth IS NOT NULL").groupBy("range").agg(*(F.max_by(place(d), F.when(F.col("depth") == d, F.col("key"))).alias(f"last{d}") for d in places)), "range", "left")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    carried = ends.select("range", *(F.last(f"last{d}", ignorenulls=True).over(before).alias(f"carried{d}") for d in places))
    sweep = Window.partitionBy("range").orderBy("key", F.col("depth").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = events.select("range", "key", "host", *(F.last(place(d), ignorenulls=True).over(sweep).alias(f"place{d}") for d in places)).where("host IS NOT NULL")
    stack = F.array(*(F.coalesce(f"place{d}", f"carried{d}") for d in places))
    held = swept.join(carried, "range").select("host", F.filter(stack, lambda e: e.isNotNull() & F.startswith(F.col("key"), e["key"])).alias("stack"))
    return held.where(F.size("stack") > 0)


def _rank(host: Column, path: Column, verdict: Column) -> Column:
    return F.struct((F.length(host) + F.length(path)).alias("n"), F.length(host).alias("h"), F.concat(host, path).alias("rule"), verdict.alias("verdict"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url", few: int = FEW) -> DataFrame:
    """``pages`` with host, path, rule and verdict."""
    rules = rules.where(F.col("host").isNotNull()).select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    rules = stored(rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict")), "url-rules")
    kept = [c for c in pages.columns if c not in RESULTS]
    named = pages.select(*(F.col(f"`{c}`") for c in kept), host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"))
    numbers = rules.groupBy("host").agg(F.count("*").alias("n"))
    depth, most = numbers.agg(F.max(F.size(F.split("host", r"\."))), F.max("n")).first()
    if not depth:
        return named.select(*(F.col(f"`{c}`") for c in kept), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    entry = F.struct(F.length("path").alias("n"), "path", "verdict")
    listed = rules.join(numbers.where(F.col("n") <= few), "host", "left_semi").groupBy("host").agg(F.sort_array(F.collect_list(entry), asc=False).alias("entries"))  # few at most
    many = numbers.where(F.col("n") > few).select("host", F.lit(None).cast(listed.schema["entries"].dataType).alias("entries"))
    active = stored(active_hosts(named.select("host").where("host <> ''").distinct(), listed.unionByName(many), depth), "url-stacks")

    stack, own = free_name(named, "stack"), free_name(named, "stack_host")
    fitting = F.transform(stack, lambda e: F.struct(e["host"].alias("host"), F.get(F.filter(e["entries"], lambda x: F.startswith(F.col("path"), x["path"])), F.lit(0)).alias("top")))
    best = F.array_max(F.transform(F.filter(fitting, lambda e: e["top"].isNotNull()), lambda e: _rank(e["host"], e["top"]["path"], e["top"]["verdict"])))
    judged = named.join(active.select(F.col("host").alias(own), F.col("stack").alias(stack)), F.col("host") == F.col(own), "left")
    top, found = free_name(named, "top"), free_name(named, "found")
    judged = judged.withColumn(top, best).drop(stack, own)
    if most > few:
        under = active.select("host", F.explode(F.filter("stack", lambda e: e["entries"].isNull())).alias("e")).select("host", F.col("e.host").alias("above"))
        sizes = rules.join(many.select("host"), "host", "left_semi").select(F.col("host").alias("above"), F.length("path").alias("n")).distinct()
        probes = named.select("host", "path").distinct().join(under, "host").join(sizes, "above").where(F.col("n") <= F.length("path"))
        probes = probes.select("host", "path", "above", F.expr("substring(path, 1, n)").alias("begin"))
        met = probes.join(rules.select(F.col("host").alias("above"), F.col("path").alias("begin"), "verdict"), ["above", "begin"])
        met = met.groupBy(F.col("host").alias("f_host"), F.col("path").alias("f_path")).agg(F.max(_rank(F.col("above"), F.col("begin"), F.col("verdict"))).alias("f"))
        h, p = free_name(named, "found_host"), free_name(named, "found_path")
        met = met.select(F.col("f_host").alias(h), F.col("f_path").alias(p), F.col("f").alias(found))
        judged = judged.join(met, (F.col("host") == F.col(h)) & (F.col("path") == F.col(p)), "left").withColumn(top, F.greatest(F.col(top), F.col(found)))
    return judged.select(*(F.col(f"`{c}`") for c in kept), "host", "path", F.col(top)["rule"].alias("rule"), F.coalesce(F.col(top)["verdict"], F.lit(default)).alias("verdict"))
