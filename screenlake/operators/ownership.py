"""Ownership graphs: breadth-first walks of bounded depth from any number of roots at once.

Each level is one join of the frontier with the edges, and its nodes are those no earlier level has. All walks advance
together, so there are at most ``depth`` + 1 rounds however many roots there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screenlake.config import NotReady, check
from screenlake.operators import screen
from screenlake.operators.merge import sorted_side

EDGE = ["child_lei", "parent_lei", "relationship_type"]
LEI = "^[A-Z0-9]{18}[0-9]{2}$"


def is_lei(value: Column) -> Column:
    return F.coalesce(value.rlike(LEI), F.lit(False))


def relationships(edges: DataFrame, leis: DataFrame, direction: str = "both") -> DataFrame:
    """The edges of ``leis`` (root, lei), with ``neighbour`` and its ``role``. With both directions a self-loop is there twice."""
    check(direction in ("parents", "children", "both"), "direction is parents, children or both")
    arms = []
    if direction in ("parents", "both"):
        arms.append(edges.withColumn("lei", F.col("child_lei")).join(sorted_side(leis), "lei").withColumn("neighbour", F.col("parent_lei")).withColumn("role", F.lit("parent")))
    if direction in ("children", "both"):
        # The role goes by the edge: of a self-loop it is parent.
        role = F.when(F.col("child_lei") == F.col("lei"), "parent").otherwise("child")
        arms.append(edges.withColumn("lei", F.col("parent_lei")).join(sorted_side(leis), "lei").withColumn("neighbour", F.col("child_lei")).withColumn("role", role))
    return arms[0] if len(arms) == 1 else arms[0].unionByName(arms[1])


def _cut(df: DataFrame) -> DataFrame:
    """A level, kept where executors can be lost; without a shared folder its plan is short enough to run again."""
    context = df.sparkSession.sparkContext
    shared = df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not shared:
        return df
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared)
    return df.checkpoint()


def trace(roots: DataFrame, edges: DataFrame, direction: str = "both", depth: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, truncation) of the graph of each root in ``roots`` (root).

    A node's depth and role are those of its first discovery (of several in a level, by the expanded node and then the
    role parent first); an edge is there once. A graph is truncated if its last level has an edge that it doesn't hold."""
    check(1 <= depth <= 5, "depth is between 1 and 5")
    roots = roots.select("root").distinct()
    nodes = roots.select("root", F.col("root").alias("lei"), F.lit(0).alias("depth"), F.lit("root").alias("role"))
    seen, frontier = None, nodes.select("root", "lei")
    for level in range(1, depth + 1):
        reached = _cut(relationships(edges, frontier, direction))
        new = reached.select("root", *EDGE, "relationship_status")
        seen = new if seen is None else seen.unionByName(new)
        first = F.min(F.struct("lei", F.when(F.col("role") == "parent", 0).otherwise(1).alias("turn"), "role")).alias("first")
        fresh = reached.groupBy("root", F.col("neighbour").alias("lei")).agg(first).join(sorted_side(nodes.select("root", "lei")), ["root", "lei"], "left_anti")
        fresh = _cut(fresh.select("root", "lei", F.lit(level).alias("depth"), F.col("first.role").alias("role")))
        nodes = nodes.unionByName(fresh)
        frontier = fresh.select("root", "lei")
    held = seen.groupBy("root", *EDGE).agg(F.min("relationship_status").alias("relationship_status"))
    beyond = relationships(edges, frontier, direction).select("root", *EDGE).join(sorted_side(held), ["root", *EDGE], "left_anti")
    cut = roots.join(sorted_side(beyond.select("root").distinct().withColumn("truncated", F.lit(True))), "root", "left")
    return nodes, held, cut.select("root", F.coalesce("truncated", F.lit(False)).alias("truncated"))


def hydrated(nodes: DataFrame, entities: DataFrame) -> DataFrame:
    """Nodes with name, jurisdiction and status; one without an entity has its identifier as name, and ``missing``."""
    known = entities.select("lei", "legal_name", "jurisdiction", "status")
    return nodes.join(sorted_side(known), "lei", "left").withColumn("missing", F.col("legal_name").isNull()).withColumn("legal_name", F.coalesce("legal_name", "lei"))


def screened(nodes: DataFrame, names: DataFrame, shown: int = 10) -> tuple[DataFrame, DataFrame]:
    """(nodes with the number of their strict hits, the first ``shown`` hits of each): one screen for all nodes."""
    texts = nodes.select(F.col("legal_name").alias("query")).distinct().withColumn("query_id", F.col("query"))
    hits, _ = screen.screen(texts, names, auto_fallback=False)
    counts = hits.groupBy(F.col("query_id").alias("legal_name")).agg(F.max("total").alias("matches"))
    got = nodes.join(sorted_side(counts), "legal_name", "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
    top = hits.where(F.col("position") <= shown).withColumnRenamed("query_id", "legal_name")
    return got.withColumn("has_more", F.col("matches") > shown), nodes.select("root", "lei", "legal_name").join(sorted_side(top), "legal_name")


def graph(roots: DataFrame, entities: DataFrame, edges: DataFrame, *, direction: str = "both", depth: int = 3, names: DataFrame | None = None, screen_nodes: bool = False, sanctions_ready: bool = True, lei_ready: bool = True) -> dict[str, DataFrame]:
    """``nodes``, ``edges``, ``facts`` (and ``hits``) of each root. Screening is screened, not_requested or not_ready."""
    if not lei_ready:
        raise NotReady("the entity corpus was never completed")
    found, held, cut = trace(roots, edges, direction, depth)
    nodes = hydrated(found, entities)
    out: dict[str, DataFrame] = {"edges": held}
    state = "not_requested" if not screen_nodes else "screened" if sanctions_ready and names is not None else "not_ready"
    if state == "screened":
        nodes, out["hits"] = screened(nodes, names)
    missing = F.collect_list(F.when(F.col("missing"), F.col("lei")))
    sums = [F.count("*").alias("n_nodes"), F.array_sort(missing).alias("missing_leis")]
    if state == "screened":
        sums += [F.count("*").alias("screened_nodes"), F.count_if(F.col("matches") > 0).alias("flagged_nodes")]
    facts = nodes.groupBy("root").agg(*sums).join(sorted_side(cut), "root")
    out["facts"] = facts.withColumn("complete", ~F.col("truncated") & (F.size("missing_leis") == 0)).withColumn("screening", F.lit(state))
    out["nodes"] = nodes.withColumn("place", F.row_number().over(Window.partitionBy("root").orderBy("depth", "lei")))
    return out


