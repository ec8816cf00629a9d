"""Exact top-k search by integer inner product.

Method: M-trees searched best first. Vectors x get one more component sqrt(R^2 - |x|^2), R being the
largest norm of the tree, and queries a zero: then |q - x|^2 = |q|^2 + R^2 - 2 <q, x>, so the nearest
are those with the largest inner product, in a metric. Each tree (up to ``TREE`` vectors or so) is a file in the shared
folder: leaf pages with vectors and their distances to the routing vector, then the directory of the inner nodes with
routing vectors, covering radii and distances to their parents. A page is read when a search first comes to it.

Each query of a block takes its own open nodes with the smallest lower bounds next, one at first and twice as many each time,
and is done when no bound is below its k-th distance; queries that take the same node at a time share the work on it. A node or vector is skipped without computing its
distance where | d(q, parent) - d(x, parent) | - radius is above that bound already. The first tree gives each query a
bound to begin with in all others. Scores are exact integers.

Each block of queries meets every tree; a query's candidates are its k best of each tree, and the last step
ranks them. Vectors that are null, empty or hold null or non-finite components take no part, nor do rows without
an id. Queries see vectors of their own length, long ones too. Repeated rows are candidates each, but a row with the
query's own id is not. Components whose products exceed 64 bits are multiplied as integers of any size; a score
beyond 64 bits is given as the nearest 64-bit number, and such scores tie. Empty tables give an empty result. Only id
and vector are read, so other columns cannot clash.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import file_system, new_path, stored

TREE, LEAF, FAN, QUERIES = 16_384, 128, 16, 512
SLACK = 1e-9
LEAST, MOST = -(2**63), 2**63 - 1


def whole(v: np.ndarray, times: int = 1) -> np.ndarray:
    """floor(times x): int64 where products of two such vectors fit 64 bits, else Python integers."""
    top = float(np.abs(v).max(initial=0))
    if top < 2**31 and (times * top + 1) ** 2 * v.shape[1] < 2**62:
        return np.floor(times * v).astype(np.int64)
    return np.array([[math.floor(times * x) if abs(x) < 2.0**53 else times * int(x) for x in row] for row in v.tolist()], dtype=object).reshape(v.shape)


def exponents(v: np.ndarray) -> np.ndarray:
    """The power of two that each row stays below."""
    return np.array([int(x).bit_length() for x in np.abs(v).max(axis=1, initial=0)], np.int64)


def scaled(v: np.ndarray, power: np.ndarray) -> np.ndarray:
    """Rows divided by powers of two, as doubles."""
    if v.dtype != object:
        return np.ldexp(v.astype(float), -power[:, None])
    return np.array([[x / 2 ** int(p) for x in row] for row, p in zip(v, power, strict=True)], float).reshape(v.shape)


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products. Doubles hold them exactly up to 2^53; beyond that int64 or Python integers do."""
    if a.dtype == object or b.dtype == object:
        return a.astype(object) @ b.astype(object).T
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return np.rint(a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T if most < 2**62 else a.astype(object) @ b.astype(object).T


def dump(ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF, fan: int = FAN) -> bytes:
    """The file of an M-tree over integer vectors, built from the top: vectors go to the nearest of up to ``fan`` spread-out routing vectors."""
    power = exponents(vectors).max(initial=0)
    v = scaled(vectors, np.full(len(vectors), power))
    norm = np.einsum("ij,ij->i", v, v)
    reach = float(norm.max(initial=0))
    points = np.c_[v, np.sqrt(np.maximum(reach - norm, 0))]
    out, names = io.BytesIO(), ("centre", "radius", "parent", "apart", "begin", "end")
    nodes: dict[str, list] = {c: [] for c in names}
    todo = [(np.arange(len(v)), points.mean(axis=0), -1, 0.0)]
    while todo:
        rows, centre, parent, apart = todo.pop()
        far = np.sqrt(((points[rows] - centre) ** 2).sum(axis=1))
        begin = end = 0
        if len(rows) <= leaf or far.max() == 0:
            by = rows[np.argsort(far, kind="stable")]
            begin = out.tell()
            page = {"ids": ids[by], "far": np.sort(far)} | ({"vectors": vectors[by]} if vectors.dtype != object else {"digits": np.array([[str(x) for x in r] for r in vectors[by]])})
            np.savez(part := io.BytesIO(), **page)
            out.write(part.getvalue())
            end = out.tell()
        else:
            picks, near, which = [int(far.argmax())], None, np.zeros(len(rows), np.int64)
            for k in range(fan):  # each routing vector is the one farthest from those before
                d = np.sqrt(((points[rows] - points[rows[picks[k]]]) ** 2).sum(axis=1))
                closer = np.ones(len(rows), bool) if near is None else d < near
                which[closer], near = k, d if near is None else np.minimum(d, near)
                if k + 1 == fan or near.max() == 0:
                    break
                picks.append(int(near.argmax()))
            for k in range(len(picks)):
                part_rows = rows[which == k]
                middle = points[part_rows].mean(axis=0)
                todo.append((part_rows, middle, len(nodes["parent"]), float(np.sqrt(((middle - centre) ** 2).sum()))))
        for c, value in zip(names, (centre, float(far.max()), parent, apart, begin, end), strict=True):
            nodes[c].append(value)
    np.savez(head := io.BytesIO(), power=power, reach=reach, **{c: np.array(x) for c, x in nodes.items()})
    at = out.tell()
    out.write(head.getvalue() + at.to_bytes(8, "little"))
    return out.getvalue()


class Tree:
    """An M-tree in a file that can seek; its pages are read as searches come to them."""

    def __init__(self, file):
        self.file = file
        size = file.seek(0, 2) or file.tell()
        at = int.from_bytes(self._bytes(size - 8, size), "little")
        got = np.load(io.BytesIO(self._bytes(at, size - 8)))
        self.power, self.reach = int(got["power"]), float(got["reach"])
        self.centre, self.radius, self.apart, self.begin, self.end = (got[c] for c in ("centre", "radius", "apart", "begin", "end"))
        self.children = [np.flatnonzero(got["parent"] == k) for k in range(len(self.radius))]
        self.pages: dict[int, tuple] = {}

    def _bytes(self, a: int, z: int) -> bytes:
        self.file.seek(a)
        return self.file.read(z - a)

    def page(self, node: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, distances to the routing vector, vectors) of a leaf."""
        if node not in self.pages:
            got = np.load(io.BytesIO(self._bytes(int(self.begin[node]), int(self.end[node]))))
            vectors = got["vectors"] if "vectors" in got else np.array([[int(x) for x in r] for r in got["digits"]], dtype=object)
            self.pages[node] = got["ids"], got["far"], vectors
        return self.pages[node]

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, least: list | None = None) -> list[list[tuple]]:
        """Each query's k best as (-score, id), best first; ties to the smaller id. ``least``: a score of each query (or None)
        that k others are known to reach."""
        n = len(queries)
        power = exponents(queries)
        q = np.c_[scaled(queries, power), np.zeros(n)]
        base = np.einsum("ij,ij->i", q, q) + self.reach  # squared distance = base - 2 score, all scaled
        room = SLACK * (1 + np.sqrt(base))
        best: list[list[tuple]] = [[] for _ in range(n)]
        limit = np.full(n, np.inf)

        def bounded(i: int, score: int) -> None:
            reached = score / 2 ** (int(power[i]) + self.power)
            limit[i] = min(limit[i], math.sqrt(max(base[i] - 2 * reached, 0.0)) + room[i])

        for i, score in enumerate(least or []):
            if score is not None:
                bounded(i, score)
        far = np.sqrt(((q - self.centre[0]) ** 2).sum(axis=1))
        open_, step = [np.arange(n), np.zeros(n, np.int64), far, far - self.radius[0]], 1
        while len(open_[0]):
            kept = open_[3] <= limit[open_[0]]
            open_ = [x[kept] for x in open_]
            order = np.lexsort((open_[1], open_[3], open_[0]))
            open_ = [x[order] for x in open_]
            begins = np.flatnonzero(np.r_[True, open_[0][1:] != open_[0][:-1]]) if len(order) else np.empty(0, np.int64)
            place = np.arange(len(order)) - np.repeat(begins, np.diff(np.r_[begins, len(order)]))
            more = [[x[place >= step]] for x in open_]
            query, node, far, _ = (x[place < step] for x in open_)
            by = np.argsort(node, kind="stable")
            query, node, far = query[by], node[by], far[by]
            cuts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]]).tolist() if len(node) else []
            for a, z in zip(cuts, [*cuts[1:], len(node)], strict=False):
                number, at, d = int(node[a]), query[a:z], far[a:z]
                some = d - self.radius[number] <= limit[at]  # limits may have fallen in this round
                at, d = at[some], d[some]
                if not len(at):
                    continue
                if not len(self.children[number]):
                    self._leaf(number, at, d, limit, query_ids, queries, best, k, bounded)
                    continue
                for child in self.children[number]:
                    maybe = np.abs(d - self.apart[child]) - self.radius[child] <= limit[at]  # from stored distances alone
                    some = at[maybe]
                    real = np.sqrt(((q[some] - self.centre[child]) ** 2).sum(axis=1))
                    near = real - self.radius[child] <= limit[some]
                    for x, value in zip(more, (some[near], np.full(near.sum(), child), real[near], real[near] - self.radius[child]), strict=True):
                        x.append(value)
            open_ = [np.concatenate(x) for x in more]
            step *= 2
        return best

    def _leaf(self, number, at, d, limit, query_ids, queries, best, k, bounded) -> None:
        ids, far, vectors = self.page(number)
        # vectors lie by distance to the routing vector: the triangle inequality leaves a ring
        low = int(np.searchsorted(far, (d - limit[at]).min(), side="left"))
        high = int(np.searchsorted(far, (d + limit[at]).max(), side="right"))
        if low >= high:
            return
        ids = ids[low:high]
        scores = exact(queries[at], vectors[low:high])
        small = scores.dtype != object
        kth = [-best[i][-1][0] if len(best[i]) == k else LEAST for i in at.tolist()]
        better = np.flatnonzero(scores.max(axis=1) >= np.array(kth)).tolist() if small else range(len(at))
        for n in better:
            i, row = int(at[n]), scores[n]
            if small and len(ids) > k:  # all that tie with the k-th best stay, and one more for the query's own row
                some = np.flatnonzero(row >= max(kth[n], np.partition(row, len(row) - k - 1)[len(row) - k - 1])).tolist()
            else:
                some = range(len(ids))
            new = [(-max(min(int(row[j]), MOST), LEAST), int(ids[j])) for j in some if ids[j] != query_ids[i]]
            if new:
                best[i] = sorted(best[i] + new)[:k]
                if len(best[i]) == k and -best[i][-1][0] > LEAST:
                    bounded(i, -best[i][-1][0])


def _write(fs, root: str, name: str, data: bytes) -> str:
    """Writes a file under a name of this attempt's own and returns it; only committed attempts' names are read."""
    own = f"{name}-{TaskContext.get().taskAttemptId()}"
    with fs.open_output_stream(f"{root}/{own}") as out:
        out.write(data)
    return own


def search(table: DataFrame, k: int = 5, every: int = 50, times: int = 256, vector: str = "embedding", id_col: str = "vec_id", tree_rows: int = TREE, query_rows: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all rows but the query's own, for ids divisible by ``every``."""
    spark = table.sparkSession
    finite = F.coalesce(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & (F.size("v") > 0), F.lit(False))
    given = table.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v")).where(F.col("id").isNotNull() & finite)
    # a table, so that the numbers of rows and the trees see the same ones
    rows = stored(given.select("id", "v", F.size("v").alias("width"), F.monotonically_increasing_id().alias("row")), "search-rows")
    sizes = rows.groupBy("width").agg(F.count("*").alias("n"), F.sum((F.col("id") % every == 0).cast("long")).alias("q"))
    sizes = stored(sizes.where("q > 0").select("width", F.ceil(F.col("n") / tree_rows).alias("trees"), F.ceil(F.col("q") / query_rows).alias("blocks")), "search-widths")
    folder = new_path(spark, "m-trees")

    def built(of: DataFrame, number: str, kind: str) -> DataFrame:
        """Writes the groups of ``of`` as files and returns their names: a row for each."""

        def run(key: tuple, group: pa.Table) -> pa.Table:
            width, one = (x.as_py() for x in key)
            ids = group.column("id").to_numpy()
            v = group.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), width)
            by = np.lexsort((*v.T[::-1], ids))
            ids, v = ids[by], v[by]
            fs, root = file_system(folder)
            fs.create_dir(root, recursive=True)
            if kind == "queries":
                np.savez(out := io.BytesIO(), ids=ids, vectors=v)
            name = _write(fs, root, f"{kind}-{width}-{one}", out.getvalue() if kind == "queries" else dump(ids, whole(v, times)))
            return pa.table({"width": pa.array([width], pa.int32()), "number": pa.array([one], pa.int32()), "name": [name]})

        grouped = of.withColumn("number", F.pmod(F.xxhash64("id", "row"), number).cast("int")).groupBy("width", "number")
        return stored(grouped.applyInArrow(run, "width int, number int, name string"), kind)

    known = rows.join(sizes, "width")
    trees = built(known, "trees", "tree").select("width", F.col("number").alias("tree_number"), F.col("name").alias("tree"))
    blocks = built(known.where(F.col("id") % every == 0), "blocks", "queries").select("width", F.col("name").alias("queries"))
    # names of files: the tree of the smallest number is every block's first, then each block meets each other tree
    smallest = trees.groupBy("width").agg(F.min("tree_number").alias("smallest"))
    tasks = trees.join(smallest, "width").join(blocks, "width")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)

    def met(of: DataFrame) -> DataFrame:
        """``of``: tree, queries, least (place, score) of the queries that have a bound already."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fs, root = file_system(folder)
            for batch in batches:
                for name, block, known in zip(*(batch.column(c).to_pylist() for c in ("tree", "queries", "least")), strict=True):
                    with fs.open_input_stream(f"{root}/{block}") as f:
                        got = np.load(io.BytesIO(f.read()))
                    ids, v = got["ids"], whole(got["vectors"], times)
                    bounds = {x["place"]: x["score"] for x in known or []}
                    with fs.open_input_file(f"{root}/{name}") as file:
                        best = Tree(file).search(ids, v, k, [bounds.get(i) for i in range(len(ids))])
                    flat = [(int(ids[i]), i, block, j, -s) for i, b in enumerate(best) for s, j in b]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*flat, strict=True) if flat else [[]] * 5, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["query_id", "place", "block", "vec_id", "score"])

        return of.repartition(parts, "tree", "queries").select("tree", "queries", "least").mapInArrow(run, "query_id bigint, place bigint, block string, vec_id bigint, score bigint")

    none = F.lit(None).cast("array<struct<place:bigint,score:bigint>>").alias("least")
    first = stored(met(tasks.where("tree_number = smallest").select("tree", "queries", none)), "search-first")
    kth = first.groupBy("block", "place").agg(F.count("*").alias("n"), F.min("score").alias("score")).where((F.col("n") == k) & (F.col("score") > LEAST))
    least = kth.groupBy(F.col("block").alias("queries")).agg(F.collect_list(F.struct("place", "score")).alias("least"))  # one for each query of a block
    found = first.unionByName(met(tasks.where("tree_number > smallest").join(least, "queries", "left")))
    # a query row is told by its block and place, since ids may repeat
    rank = F.row_number().over(Window.partitionBy("query_id", "block", "place").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
