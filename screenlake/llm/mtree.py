"""Exact top-k search: best-first in a paged M-tree, some rows the queries, all rows searched.

The tree is grown from the top. A node of more than ``cell`` points is divided: points drawn from it by hash become the
routing objects of its children, at most ``fan``, and every point goes to the nearest; all large nodes of a level are
divided together, whatever their number. A node without children is a cell, stored as pages of about ``page`` points.
Nodes and pages have a routing object, its distance to that of their parent, and a covering radius; each point of a page
has its distance to the routing object. Copies of one point tie between equal routing objects and are dealt to them by
their hash, so a point that a third of all rows repeat divides as well.

A search visits pages by their lower bound, the distance to the routing object less the radius, and ends when that is
over the k-th distance found. A node, page or point that its stored parent distance rules out by the triangle inequality
isn't compared at all. A query searches its own cell first; it then knows a k-th distance and goes down from the root to
the cells that this doesn't rule out. Distances are Euclidean; on vectors of one length their order is that of the
cosine. In data without structure no bound rules much out, and an exact search compares nearly all pairs of a query and
a point: no method avoids that.

A task holds the children of a node or the points of a cell, and what asks there streams past. Nodes and cells are moved
only where something asks; where more than ``batch`` rows do, they are dealt to copies. Nothing is sent to every task.

Defined results: the queries are the ids divisible by ``every`` (of ids that aren't integers, their 64-bit hashes); rows
without an id or vector, or with nulls or non-finite values in it, and vectors of another length than most (the shorter,
if as many) have no neighbours and are none; rows that repeat an id are one point, with the smallest of their vectors;
an id isn't its own neighbour; ties go by id (by hash, if it isn't an integer); points with fewer than ``k`` others have
these; other columns are ignored, whatever they are called; an empty table has no rows.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from screenlake.llm.ids import integral, key_of
from screenlake.llm.storage import staged
from screenlake.llm.textcols import mix

K = 10
EVERY = 20
#: A bound is let through if it is over by less than this share: distances have rounding errors.
SLACK = 1e-9


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all pairs, with rounding errors."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T), 0)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of rows, each by itself: equal pairs have equal ones."""
    return np.sqrt(np.square(a - b).sum(1))


@dataclass
class Tree:
    """Pages of a tree: routing objects, their distance to the root and radius; vectors by page, their distance to it."""

    routing: np.ndarray
    to_root: np.ndarray
    radius: np.ndarray
    pointer: np.ndarray
    ids: np.ndarray
    vectors: np.ndarray
    to_page: np.ndarray
    compared: int = 0

    @classmethod
    def build(cls, ids: np.ndarray, vectors: np.ndarray, to_root: np.ndarray, page: int = 128) -> "Tree":
        """In bulk: routing objects are drawn by hash, points go to the nearest. ``to_root``: their distances to the root."""
        n = len(ids)
        drawn = np.argsort(mix(ids.astype(np.int64).view(np.uint64)), kind="stable")[: max(1, math.ceil(n / page))]
        routing = vectors[drawn]
        at = np.concatenate([squares(vectors[lo : lo + 4096], routing).argmin(1) for lo in range(0, n, 4096)])
        order = np.lexsort((ids, at))
        ids, vectors, at = ids[order], vectors[order], at[order]
        to_page = distance(vectors, routing[at])
        pointer = np.searchsorted(at, np.arange(len(routing) + 1))
        radius = np.zeros(len(routing))
        np.maximum.at(radius, at, to_page)
        return cls(routing, to_root[drawn], radius, pointer, ids, vectors, to_page)

    @classmethod
    def stored(cls, rows: pa.Table) -> "Tree":
        """From the rows of its pages, in any order."""
        ids, radius, page = rows["vec_id"].to_numpy(), rows["radius"].to_numpy(), rows["page"].to_numpy()
        order = np.lexsort((ids, page))
        route = radius[order] >= 0
        x, to = matrix(rows["embedding"])[order], rows["to_parent"].to_numpy()[order]
        pointer = np.searchsorted(page[order][~route], np.arange(int(route.sum()) + 1))
        return cls(x[route], to[route], radius[order][route], pointer, ids[order][~route], x[~route], to[~route])

    def search(self, ids: np.ndarray, queries: np.ndarray, to_root: np.ndarray, limit: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, distance) of the ``k`` nearest within ``limit`` of each query, by query, distance and id."""
        n, pages = len(ids), len(self.routing)
        limit = limit.copy()
        open_ = lambda bound, q: bound <= limit[q] * (1 + SLACK) + SLACK
        to = np.full((n, pages), np.inf)
        for j in range(pages):
            # The stored distance to the root rules a page out without a look at its routing object.
            near = np.flatnonzero(open_(np.abs(to_root - self.to_root[j]) - self.radius[j], slice(None)))
            to[near, j] = distance(queries[near], self.routing[j][None, :])
            self.compared += len(near)
        bound = np.maximum(to - self.radius, 0)
        order = np.argsort(bound, axis=1, kind="stable")
        # Distances stand as squared in what is compared; norms are needed once.
        q2, v2 = (queries * queries).sum(1), (self.vectors * self.vectors).sum(1)
        best: tuple[np.ndarray, np.ndarray, np.ndarray] = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        active = np.arange(n)
        for step in range(pages):
            page = order[active, step]
            alive = open_(bound[active, page], active) & np.isfinite(bound[active, page])
            active, page = active[alive], page[alive]
            if not len(active):
                break
            by = np.argsort(page, kind="stable")
            edge = np.flatnonzero(np.concatenate(([True], np.diff(page[by]) != 0)))
            new: list[tuple[np.ndarray, np.ndarray]] = []
            for lo, hi in zip(edge, np.append(edge[1:], len(by))):
                q, j = active[by[lo:hi]], page[by[lo]]
                o = np.arange(self.pointer[j], self.pointer[j + 1])
                reach = limit[q] * (1 + SLACK) + SLACK
                gap = np.abs(to[q, j][:, None] - self.to_page[o]) <= reach[:, None]
                o, gap = o[gap.any(0)], gap[:, gap.any(0)]
                if not len(o):
                    continue
                self.compared += len(q) * len(o)
                d = q2[q][:, None] + v2[o] - 2 * (queries[q] @ self.vectors[o].T)
                i, c = np.nonzero(gap & (d <= (reach * reach)[:, None] + SLACK))
                new.append((q[i], o[c]))
            q, o = (np.concatenate([x[i] for x in new] or [np.zeros(0, np.int64)]) for i in (0, 1))
            other = self.ids[o] != ids[q]
            q, o = q[other], o[other]
            if len(q):
                d = distance(queries[q], self.vectors[o])
                best = _nearest(np.concatenate((best[0], q)), np.concatenate((best[1], self.ids[o])), np.concatenate((best[2], d)), k)
                count = np.bincount(best[0], minlength=n)
                last = np.cumsum(count) - 1
                full = count >= k
                limit[full] = np.minimum(limit[full], best[2][last[full]])
        inside = best[2] <= limit[best[0]]
        return best[0][inside], best[1][inside], best[2][inside]


def _nearest(q: np.ndarray, ids: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first ``k`` by distance and id of each query."""
    order = np.lexsort((ids, d, q))
    q, ids, d = q[order], ids[order], d[order]
    first = np.searchsorted(q, q)
    keep = np.arange(len(q)) - first < k
    return q[keep], ids[keep], d[keep]


@dataclass(frozen=True)
class Shape:
    """Vectors of a cell at the most, children of an inner node, vectors of a page, queries that come to a copy of a node together."""

    cell: int = 8192
    fan: int = 64
    page: int = 128
    batch: int = 8192


def points(rows: DataFrame) -> tuple[DataFrame, DataFrame | None, int, int]:
    """(vec_id long, embedding) of the usable points, written once; the ids by key where they aren't integers; how many; their length."""
    kind = "array<float>" if rows.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    got = rows.select(F.col("vec_id").alias("name"), key_of(rows, "vec_id").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    got = got.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & sound)
    most = got.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if most is None:
        return got.select("vec_id", "embedding"), None, 0, 0
    got = got.where(F.size("embedding") == most["n"]).groupBy("vec_id").agg(F.min("embedding").alias("embedding"), F.min("name").alias("name"))
    got = staged(got, "points")
    return got.select("vec_id", "embedding"), None if integral(rows, "vec_id") else got.select("vec_id", "name"), got.count(), most["n"]


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[int, ...]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """(whether a new group begins, slice within one group) of batches sorted by the key columns."""
    last: tuple | None = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(i).to_numpy() for i in keys]
        new = np.ones(b.num_rows, bool)
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
        edge = np.flatnonzero(new)
        for lo, hi in zip(edge.tolist(), [*edge[1:].tolist(), b.num_rows]):
            own = tuple(c[lo] for c in cols)
            yield own != last, b.slice(lo, hi - lo)
            last = own


def _met(stored: DataFrame, asking: DataFrame, batch: int) -> DataFrame:
    """Rows of ``stored`` (kind 0) and ``asking`` (kind 1) with ``node`` and ``salt``, those of a node together and ``stored`` first.

    Where more than ``batch`` rows ask at a node they are dealt to salts, and what the node stores goes to each; a node
    at which nobody asks isn't moved."""
    asked = staged(asking.groupBy("node").agg(F.ceil(F.count("*") / batch).cast("int").alias("salts")), "salts")
    here = stored.join(asked, "node").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts").withColumn("kind", F.lit(0))
    there = asking.join(asked, "node").withColumn("salt", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.col("salts")).cast("int")).drop("salts").withColumn("kind", F.lit(1))
    return here.unionByName(there, allowMissingColumns=True).repartition("node", "salt").sortWithinPartitions("node", "salt", "kind")


def _root() -> Column:
    """The node 0, not as a constant: a join on it is then one by key."""
    return F.pmod(F.col("vec_id"), F.lit(1)).cast("long")


class Forest:
    """The tree of a table, by tables in the shared folder.

    ``nodes``: (node, parent, inner, embedding, to_parent, radius) of every node but the root, which is 0. ``pages``: (node,
    page, vec_id, embedding, to_parent, radius) of the cells, which are the nodes without children. ``home``: (vec_id, node)."""

    def __init__(self, had: DataFrame, width: int, shape: Shape) -> None:
        self.shape, self.kind = shape, had.schema["embedding"].dataType.simpleString()
        self._grow(had, width)

    def _grow(self, had: DataFrame, width: int) -> None:
        """Nodes of more than ``cell`` points are divided, level by level, among points drawn from them by hash."""
        shape, kind, value = self.shape, self.kind, np.float32 if "float" in self.kind else np.float64
        at = had.select("vec_id", "embedding", _root().alias("node"), F.lit(float("nan")).alias("to_parent"))
        big = had.groupBy(_root().alias("node")).agg(F.count("*").alias("n"))
        done: list[DataFrame] = []
        nodes: list[DataFrame] = []

        def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Each point goes to the nearest drawn one. Equal ones share those that tie, so that copies divide too."""
            held: list[pa.RecordBatch] = []
            drawn = place = None
            for new, b in _groups(batches, (0, 1)):
                if new:
                    held, drawn = [], None
                kinds = b.column(2).to_numpy()
                split = int(np.searchsorted(kinds, 1))
                if split:
                    held.append(b.slice(0, split))
                for lo in range(split, b.num_rows, 4096):
                    if drawn is None:
                        drawn, place = np.concatenate([matrix(h.column(4)) for h in held]), np.concatenate([h.column(6).to_numpy() for h in held])
                        order = np.argsort(place)
                        drawn, place = drawn[order], place[order]
                    p = b.slice(lo, 4096)
                    x, ids = matrix(p.column(4)), p.column(3).to_numpy()
                    d = squares(x, drawn)
                    tie = d <= (d.min(1) + 1e-12 * (1 + (x * x).sum(1)))[:, None]
                    nth = (mix(ids.view(np.uint64) + np.uint64(17)) % tie.sum(1).astype(np.uint64)).astype(np.int64)
                    best = (np.cumsum(tie, 1) > nth[:, None]).argmax(1)
                    child = p.column(0).to_numpy() * shape.fan + 1 + place[best]
                    yield pa.RecordBatch.from_arrays([p.column(3), p.column(4), pa.array(child), pa.array(distance(x, drawn[best]))], ["vec_id", "embedding", "node", "to_parent"])

        for level in range(9):  # 64 ** 9 nodes; what is left then stays in large cells
            chosen = at.join(big, "node")
            w = Window.partitionBy("node").orderBy(F.xxhash64("vec_id", F.lit(level)), "vec_id")
            drawn = chosen.withColumn("place", F.row_number().over(w)).where(F.col("place") <= shape.fan)
            drawn = staged(drawn.where(F.col("place") <= F.ceil(2 * F.col("n") / shape.cell)).select("node", "vec_id", "embedding", "to_parent", (F.col("place") - 1).cast("long").alias("place")), "drawn")
            both = _met(drawn.select("node", "vec_id", "embedding", "to_parent", "place"), chosen.select("node", "vec_id", "embedding", "to_parent"), 8 * shape.cell)
            moved = staged(both.select("node", "salt", "kind", "vec_id", "embedding", "to_parent", "place").mapInArrow(dealt, f"vec_id long, embedding {kind}, node long, to_parent double"), "level")
            sums = staged(moved.groupBy("node").agg(F.max("to_parent").alias("radius"), F.count("*").alias("n")), "sums")
            child = (F.col("node") * shape.fan + 1 + F.col("place")).alias("node")
            nodes.append(drawn.select(child, F.col("node").alias("parent"), "embedding", "to_parent").join(sums, "node").select("node", "parent", (F.col("n") > shape.cell).alias("inner"), "embedding", "to_parent", "radius"))
            big = sums.where(F.col("n") > shape.cell).select("node", "n")
            done.append(moved.join(big, "node", "left_anti"))
            at = moved
            if big.isEmpty():
                break
        else:
            done.append(at.join(big, "node"))
            nodes[-1] = nodes[-1].withColumn("inner", F.lit(False))
        cells = functools.reduce(DataFrame.unionByName, [d.select("vec_id", "embedding", "node", "to_parent") for d in done])
        self.nodes = staged(functools.reduce(DataFrame.unionByName, nodes), "nodes")
        self.home = cells

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []

            def packed() -> pa.RecordBatch:
                node = held[0].column(0)[0].as_py()
                ids, x, to = np.concatenate([h.column(1).to_numpy() for h in held]), np.concatenate([matrix(h.column(2)) for h in held]), np.concatenate([h.column(3).to_numpy() for h in held])
                t = Tree.build(ids, x, to, shape.page)
                m, o = len(t.routing), len(t.ids)
                cols = [pa.array([node] * (m + o), pa.int64()), pa.array(np.concatenate((np.arange(m), np.repeat(np.arange(m), np.diff(t.pointer)))), pa.int32()), pa.array(np.concatenate((np.zeros(m, np.int64), t.ids)), pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(0, (m + o) * width + 1, width), pa.int32()), pa.array(np.concatenate((t.routing, t.vectors)).astype(value).ravel())), pa.array(np.concatenate((t.to_root, t.to_page))), pa.array(np.concatenate((t.radius, np.full(o, -1.0))))]
                return pa.RecordBatch.from_arrays(cols, ["node", "page", "vec_id", "embedding", "to_parent", "radius"])

            for new, b in _groups(batches, (0,)):
                if new and held:
                    yield packed()
                    held = []
                held.append(b)
            if held:
                yield packed()

        rows = cells.select("node", "vec_id", "embedding", "to_parent").repartition("node").sortWithinPartitions("node")
        self.pages = staged(rows.mapInArrow(build, f"node long, page int, vec_id long, embedding {kind}, to_parent double, radius double"), "pages")

    def look(self, visits: DataFrame, k: int) -> DataFrame:
        """(vec_id, neighbour, distance): for visits (vec_id, node, embedding, to_node, reach), the nearest in the cell within reach."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            tree: Tree | None = None
            for new, b in _groups(batches, (0, 1)):
                if new:
                    held, tree = [], None
                split = int(np.searchsorted(b.column(2).to_numpy(), 1))
                if split:
                    held.append(b.slice(0, split))
                for lo in range(split, b.num_rows, 1024):
                    if tree is None:
                        tree, held = Tree.stored(pa.Table.from_batches(held)), []
                    p = b.slice(lo, 1024)
                    ids = p.column(3).to_numpy()
                    i, near, d = tree.search(ids, matrix(p.column(4)), p.column(8).to_numpy(), p.column(9).to_numpy(), k)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(near), pa.array(d)], ["vec_id", "neighbour", "distance"])

        met = _met(self.pages, visits, self.shape.batch)
        cols = ["node", "salt", "kind", "vec_id", "embedding", "page", "to_parent", "radius", "to_node", "reach"]
        return met.select(*cols).mapInArrow(run, "vec_id long, neighbour long, distance double")

    def reached(self, asking: DataFrame) -> DataFrame:
        """(vec_id, node, embedding, to_node, reach) of the cells that bounds don't rule out, for (vec_id, embedding, reach), from the root down."""
        kind = self.kind

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            have: tuple | None = None
            for new, b in _groups(batches, (0, 1)):
                if new:
                    held, have = [], None
                split = int(np.searchsorted(b.column(2).to_numpy(), 1))
                if split:
                    held.append(b.slice(0, split))
                for lo in range(split, b.num_rows, 4096):
                    if have is None:
                        have = tuple(np.concatenate([f(h.column(i)) for h in held]) for i, f in ((4, matrix), (5, pa.Array.to_numpy), (6, pa.Array.to_numpy), (7, pa.Array.to_numpy), (8, lambda c: c.to_numpy(zero_copy_only=False))))
                    x, to_parent, radius, child, inner = have
                    p = b.slice(lo, 4096)
                    q, to_node, reach = matrix(p.column(4)), p.column(9).to_numpy(), p.column(10).to_numpy()
                    limit = reach * (1 + SLACK) + SLACK
                    with np.errstate(invalid="ignore"):  # the root has no routing object
                        near = ~(np.abs(to_node[:, None] - to_parent) - radius > limit[:, None])
                    i, j = np.nonzero(near)
                    d = np.concatenate([distance(q[i[s : s + 65536]], x[j[s : s + 65536]]) for s in range(0, len(i), 65536)] or [np.zeros(0)])
                    on = d - radius[j] <= limit[i]
                    i, j, d = i[on], j[on], d[on]
                    take = pa.array(i)
                    yield pa.RecordBatch.from_arrays([p.column(3).take(take), pa.array(child[j]), p.column(4).take(take), pa.array(d), pa.array(reach[i]), pa.array(inner[j])], ["vec_id", "node", "embedding", "to_node", "reach", "inner"])

        front = asking.select("vec_id", "embedding", _root().alias("node"), F.lit(float("nan")).alias("to_node"), "reach")
        stored = self.nodes.select(F.col("parent").alias("node"), F.lit(0).cast("long").alias("vec_id"), "embedding", "to_parent", "radius", F.col("node").alias("child"), "inner")
        cols = ["node", "salt", "kind", "vec_id", "embedding", "to_parent", "radius", "child", "inner", "to_node", "reach"]
        cells: list[DataFrame] = []
        while True:
            out = staged(_met(stored, front, self.shape.batch).select(*cols).mapInArrow(run, f"vec_id long, node long, embedding {kind}, to_node double, reach double, inner boolean"), "front")
            cells.append(out.where("NOT inner").drop("inner"))
            front = out.where("inner").drop("inner")
            if front.isEmpty():
                return functools.reduce(DataFrame.unionByName, cells)


def neighbours(rows: DataFrame, k: int = K, *, every: int = EVERY, shape: Shape = Shape()) -> DataFrame:
    """(vec_id, rank, neighbour, distance): the ``k`` nearest of all points of ``rows``, of each whose id is divisible by ``every``."""
    spark = rows.sparkSession
    had, names, n, width = points(rows)
    name = rows.schema["vec_id"].dataType.simpleString() if not integral(rows, "vec_id") else "long"
    if not n:
        return spark.createDataFrame([], f"vec_id {name}, rank int, neighbour {name}, distance double")
    forest = Forest(had, width, shape)
    asking = staged(forest.home.where(F.pmod("vec_id", F.lit(every)) == 0).withColumnRenamed("to_parent", "to_node"), "queries")
    home = staged(forest.look(asking.withColumn("reach", F.lit(float("inf"))), k), "home")
    reach = home.groupBy("vec_id").agg(F.when(F.count("*") >= k, F.max("distance")).otherwise(float("inf")).alias("reach"))
    # No other point in the cell: nothing was found there.
    open_ = asking.select("vec_id", "embedding", F.col("node").alias("own")).join(reach, "vec_id", "left").withColumn("reach", F.coalesce("reach", F.lit(float("inf"))))
    away = forest.reached(open_).join(asking.select("vec_id", "node"), ["vec_id", "node"], "left_anti")
    every_ = home.unionByName(forest.look(away, k))
    w = Window.partitionBy("vec_id").orderBy("distance", "neighbour")
    ranked = every_.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("vec_id", "rank", "neighbour", F.round("distance", 6).alias("distance"))
    if names is not None:
        for c in ("vec_id", "neighbour"):
            ranked = ranked.join(names.select(F.col("vec_id").alias(c), "name"), c).drop(c).withColumnRenamed("name", c)
    return ranked.select("vec_id", "rank", "neighbour", "distance")


ORACLE_SQL = f"""
WITH p AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
d AS (SELECT a.vec_id, b.vec_id AS neighbour, list_distance(a.e, b.e) AS distance FROM p a JOIN p b ON a.vec_id <> b.vec_id WHERE a.vec_id % {EVERY} = 0)
SELECT vec_id, rank::INTEGER AS rank, neighbour, round(distance, 6) AS distance
FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour) AS rank FROM d) WHERE rank <= {K}
"""
