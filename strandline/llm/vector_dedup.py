"""Near-duplicate vectors.

Method: cross-polytope hashing. A vector is rotated by three rounds of random signs and a fast Hadamard
transform, and its hash is the signed axis it lies nearest to; a bucket of a table is the label and the
hashes of ``functions`` rotations. Besides its own bucket a vector is put into the ``probes`` next ones
(multiprobe: one hash replaced by its runner-up, smallest gaps first), and all that meet in a bucket are
verified by their cosine in double precision.

Equal vectors of a label are one row from the start and count with their number. A bucket of up to ``block`` vectors
is compared in one task. The vectors of a larger one are written once, as files of about ``block`` vectors in the shared
folder, and its pairs of files, which are rows of names alone, are compared in any task; a task sums up before it
gives rows. What a comparison gives are sums of links for each vector and a forest of the links, not pairs.
A pair that meets in several buckets counts in the first of them.

Vectors that are null, empty, zero or hold null or non-finite components, and those without a label or
id, link with nothing: n_links 0, their own component. Repeated rows are vectors of their own that link
with one another; vectors of different length, long ones too, do not. Ties at the threshold link. An empty table gives an
empty one. Only id, label and vector are read, so other columns cannot clash.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, runs, stars, whole_runs
from .shared import file_system, new_path, stored

TABLES, FUNCTIONS, PROBES, SEED, BLOCK = 5, 2, 1, 20_240, 2048
#: Sums of links that a task holds before it gives them.
SUMS = 500_000


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of rows whose length is a power of two, in place."""
    n, step = x.shape[1], 1
    while step < n:
        v = x.reshape(len(x), -1, 2, step)
        a, b = v[:, :, 0].copy(), v[:, :, 1]
        v[:, :, 0] += b
        np.subtract(a, b, out=v[:, :, 1])
        step *= 2
    return x


def codes(x: np.ndarray, tables: int = TABLES, functions: int = FUNCTIONS, probes: int = PROBES, seed: int = SEED) -> np.ndarray:
    """(rows, tables, 1 + probes) bucket codes of unit vectors; a probe that is missing repeats the own one."""
    n, width = x.shape
    size = 1 << max(0, width - 1).bit_length()
    rng = np.random.default_rng([seed, size])
    out = np.empty((n, tables, 1 + probes), np.int64)
    rows = np.arange(n)
    for t in range(tables):
        best, second, gap = (np.empty((n, functions), kind) for kind in (np.int64, np.int64, float))
        for f in range(functions):
            y = np.zeros((n, size))
            y[:, :width] = x
            for _ in range(3):
                y *= rng.choice([-1.0, 1.0], size)
                hadamard(y)
                y /= np.sqrt(size)
            strong = np.abs(y)
            first = strong.argmax(axis=1)
            top = strong[rows, first]
            strong[rows, first] = -1
            other = strong.argmax(axis=1)
            best[:, f] = 2 * first + (y[rows, first] > 0)
            second[:, f] = 2 * other + (y[rows, other] > 0)
            gap[:, f] = top - strong[rows, other]
        place = (2 * size) ** np.arange(functions)
        own = best @ place
        out[:, t, 0] = own
        order = np.argsort(gap, axis=1, kind="stable")
        for p in range(probes):
            if p < functions:
                f = order[:, p]
                out[:, t, 1 + p] = own + (second[rows, f] - best[rows, f]) * place[f]
            else:
                out[:, t, 1 + p] = own
        out[:, t] += t * (2 * size) ** functions
    return out


def _scaled(v: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that squares neither overflow nor vanish; cosines stay as they are."""
    _, power = np.frexp(np.abs(v).max(axis=1))
    return np.ldexp(v, -power[:, None])


def links(classes: DataFrame, least: float, block: int = BLOCK, **hashing: int) -> DataFrame:
    """Rows (a, b, n) of ``classes`` (id, node, n, label, v): sums of links n at node a (b null), and a
    forest of links between ids a and b (n null)."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            size = np.diff(batch.column("v").offsets.to_numpy())
            for width in np.unique(size):
                rows = np.flatnonzero(size == width)
                part = batch.take(pa.array(rows))
                v = _scaled(part.column("v").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), width))
                key = codes(v / np.linalg.norm(v, axis=1, keepdims=True), **hashing).reshape(len(rows), -1)
                key.sort(axis=1)
                new = np.c_[np.ones(len(rows), bool), key[:, 1:] != key[:, :-1]]
                offsets = np.r_[0, np.cumsum(new.sum(axis=1))].astype(np.int32)
                cols = [*(part.column(x) for x in ("label", "id", "node", "n", "v")), pa.array(np.full(len(rows), width, np.int32)), pa.ListArray.from_arrays(offsets, pa.array(key[new]))]
                yield pa.RecordBatch.from_arrays(cols, ["label", "id", "node", "n", "v", "width", "keys"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, ["label", "bucket", "width", "tile"]):
            label, bucket, width, tile, own, ids, node, n = (table.column(c).to_numpy() for c in ("label", "bucket", "width", "tile", "own", "id", "node", "n"))
            start = runs(label, bucket, width, tile)
            end = np.r_[start[1:], len(ids)]
            for a, z in zip(start.tolist(), end.tolist(), strict=True):
                if z - a > 1:
                    yield from tile_links(table.slice(a, z - a), bucket[a], width[a], own[a:z], ids[a:z], node[a:z], n[a:z])

    def tile_links(table, bucket, width, own, ids, node, weight):
        n = len(ids)
        v = _scaled(table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, width))
        norm = np.sqrt(np.einsum("ij,ij->i", v, v))
        keys = [np.array(k) for k in table.column("keys").to_pylist()]
        # keys below this bucket decide whether an earlier bucket has the pair; the same set gives the same number
        low = [k[k < bucket] for k in keys]
        total, a_out, b_out = np.zeros(n, np.int64), [], []
        blocks = {}
        for k in range(n):
            blocks.setdefault(own[k], []).append(k)
        parts = [np.array(p) for p in blocks.values()]
        pairs = [(parts[0], parts[0])] if list(blocks) == [-1] else [(parts[0], parts[1])] if len(parts) == 2 else []
        for left, right in pairs:
            for p in range(0, len(left), 512):
                x = left[p : p + 512]
                for q in range(p if left is right else 0, len(right), 512):
                    y = right[q : q + 512]
                    near = v[x] @ v[y].T / (norm[x][:, None] * norm[y][None, :]) >= least
                    if left is right and p == q:
                        near = np.triu(near, 1)
                    i, j = np.nonzero(near)
                    if not len(i):
                        continue
                    seen = earlier(low, x, y, i, j)
                    i, j = x[i[~seen]], y[j[~seen]]
                    np.add.at(total, i, weight[j])
                    np.add.at(total, j, weight[i])
                    a_out.append(i)
                    b_out.append(j)
        if not a_out:
            return
        order = np.argsort(ids, kind="stable")
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        label = stars(n, place[np.concatenate(a_out)], place[np.concatenate(b_out)])
        moved = np.flatnonzero(label != np.arange(n))
        some = np.flatnonzero(total)
        a = np.r_[ids[order[moved]], node[some]]
        b = pa.array(np.r_[ids[order[label[moved]]], np.zeros(len(some), np.int64)], mask=np.r_[np.zeros(len(moved), bool), np.ones(len(some), bool)])
        sums = pa.array(np.r_[np.zeros(len(moved), np.int64), total[some]], mask=np.r_[np.ones(len(moved), bool), np.zeros(len(some), bool)])
        yield pa.RecordBatch.from_arrays([pa.array(a), b, sums], ["a", "b", "n"])

    def earlier(low, x, y, i, j):
        """Which pairs share one of the keys in ``low``."""
        names, at = np.unique(np.concatenate([low[k] for k in np.r_[x, y]]), return_inverse=True)
        if not len(names):
            return np.zeros(len(i), bool)
        has = np.zeros((len(x) + len(y), len(names)), np.float32)
        has[np.repeat(np.arange(len(x) + len(y)), [len(low[k]) for k in np.r_[x, y]]), at] = 1
        if len(names) * len(x) * len(y) < 4e8 and len(i) > 1000:
            return (has[: len(x)] @ has[len(x) :].T)[i, j] > 0
        return np.concatenate([(has[i[k : k + 20_000]] * has[len(x) + j[k : k + 20_000]]).any(axis=1) for k in range(0, len(i), 20_000)])

    kinds = {f.name: f.dataType.simpleString() for f in classes.schema}
    schema = f"label {kinds['label']}, id bigint, node bigint, n bigint, v {kinds['v']}, width int, keys array<bigint>"
    coded = stored(classes.select("id", "node", "n", "label", "v").mapInArrow(code, schema), "vector-codes")
    keys = ["label", "bucket", "width"]
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # buckets are counted and dealt by ids alone; vectors join those that share one
    members = coded.select("label", "width", "node", F.explode("keys").alias("bucket"))
    sizes = stored(members.groupBy(*keys).agg(F.count("*").alias("size")).where("size > 1"), "vector-buckets")
    shared = members.join(sizes, keys).join(coded.select("node", "id", "n", "v", "keys"), "node")
    small = shared.where(F.col("size") <= block).repartition(parts, *keys).sortWithinPartitions(*keys)
    result = "a bigint, b bigint, n bigint"
    within = small.select(*keys, F.lit(0).alias("tile"), F.lit(-1).alias("own"), "id", "node", "n", "v", "keys").mapInArrow(meet, result)
    if sizes.where(F.col("size") > block).isEmpty():
        return within
    folder = new_path(classes.sparkSession, "vector-blocks")

    def write(key: tuple, group: pa.Table) -> pa.Table:
        fs, root = file_system(folder)
        fs.create_dir(root, recursive=True)
        label, bucket, width, number = (x.as_py() for x in key)
        name = f"{uuid.uuid4().hex}"  # only names that come from committed tasks are read
        rows = group.select(["id", "node", "n", "v", "keys"])
        with fs.open_output_stream(f"{root}/{name}") as out, pa.ipc.new_stream(out, rows.schema) as stream:
            stream.write_table(rows)
        return pa.table({"label": pa.array([label], pa.string()), "bucket": pa.array([bucket], pa.int64()), "width": pa.array([width], pa.int32()), "number": pa.array([number], pa.int32()), "name": [name]})

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        sums: dict[int, int] = {}

        def read(name: str) -> pa.Table:
            with fs.open_input_stream(f"{root}/{name}") as f:
                return pa.ipc.open_stream(f).read_all()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.nulls(len(sums), pa.int64()), pa.array(list(sums.values()), pa.int64())], ["a", "b", "n"])
            sums.clear()
            return out

        last, left = None, None
        for batch in batches:
            for bucket, width, one, other in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if one != last:
                    last, left = one, read(one)
                right = left.slice(0, 0) if one == other else read(other)
                own = np.full(len(left), -1) if one == other else np.r_[np.zeros(len(left), np.int64), np.ones(len(right), np.int64)]
                table = pa.concat_tables([left, right]).combine_chunks()
                for out in tile_links(table, bucket, width, own, *(table.column(c).to_numpy() for c in ("id", "node", "n"))):
                    linked = pc.is_valid(out.column("b"))
                    yield out.filter(linked)
                    counted = out.filter(pc.invert(linked))
                    for node, n in zip(counted.column("a").to_pylist(), counted.column("n").to_pylist(), strict=True):
                        sums[node] = sums.get(node, 0) + n
                if len(sums) > SUMS:
                    yield flush()
        yield flush()

    large = shared.where(F.col("size") > block).withColumn("number", F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / block)).cast("int"))
    names = stored(large.groupBy(*keys, "number").applyInArrow(write, "label string, bucket bigint, width int, number int, name string"), "vector-files")
    one = names.select(*keys, F.col("number").alias("i"), F.col("name").alias("one"))
    pairs = one.join(names.select(*keys, F.col("number").alias("j"), F.col("name").alias("other")), keys).where("i <= j").select("bucket", "width", "one", "other")
    across = pairs.repartition(parts, "one", F.pmod(F.xxhash64("other"), F.lit(8))).sortWithinPartitions("one").select("bucket", "width", "one", "other").mapInArrow(compare, result)
    return within.unionByName(across)


def near_duplicates(table: DataFrame, least: float = 0.98, vector: str = "embedding", label: str = "label", id_col: str = "vec_id", block: int = BLOCK, **hashing: int) -> DataFrame:
    """One row for each vector: id, n_links, component_id, kept."""
    given = table.select(F.col(id_col).cast("bigint").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & F.exists("v", lambda c: c != 0)
    takes_part = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & finite, F.lit(False))
    classes = given.where(takes_part).groupBy("label", "v").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    # ids may repeat; a node is one class
    classes = stored(classes.withColumn("node", F.xxhash64("id", "label", "v")), "vector-classes")
    found = stored(links(classes, least, block, **hashing), "vector-links")
    sums = found.where(F.col("n").isNotNull()).groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    shared = components(found.where(F.col("n").isNull()).select("a", "b"), "vectors")
    known = classes.join(sums, "node", "left").join(shared, "id", "left")
    known = known.select("label", "v", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    inside = given.where(takes_part).join(known, ["label", "v"], "left").select("id", "n_links", "component_id")
    alone = given.where(~takes_part).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return inside.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
