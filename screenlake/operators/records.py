"""Full records, cross-screens, the source list, and the vetting of counterparties."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenlake.config import CAVEAT, NotFound, NotReady, SOURCES, Settings, check
from screenlake.operators import merge, ownership, resolve, screen


def get_designation(designations: DataFrame, source: str, entry_id: str, *, ready: bool = True) -> DataFrame:
    """The record of a source's entry; NotFound if there is none, NotReady if the lists were never completed."""
    if not ready:
        raise NotReady("the lists were never completed")
    check(source in SOURCES, f"source is one of {SOURCES}")
    got = designations.where((F.col("source") == source) & (F.col("id") == f"{source}:{entry_id}"))
    if got.limit(1).count() == 0:
        raise NotFound(f"{source} has no entry {entry_id}")
    return got


def get_entities(leis: DataFrame, entities: DataFrame, names: DataFrame | None, *, sanctions_ready: bool = True, shown: int = 25) -> tuple[DataFrame, DataFrame | None]:
    """(records of ``leis`` (lei) with the number of their strict hits and the state of the screen, those hits)."""
    found = entities.join(merge.sorted_side(leis.select("lei").distinct()), "lei", "left_semi")
    if names is None or not sanctions_ready:
        return found.select("*", F.lit(None).cast("int").alias("matches"), F.lit(None).cast("boolean").alias("has_more"), F.lit("not_ready").alias("screening")), None
    hits, facts = screen.screen(found.select(F.col("lei").alias("query_id"), F.col("legal_name").alias("query")), names, auto_fallback=False)
    # Not counted from the hits of each record, which are far more where records are called alike.
    counts = facts.select(F.col("query_id").alias("lei"), F.col("total_available").alias("matches"))
    got = found.join(merge.sorted_side(counts), "lei", "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
    return got.withColumn("has_more", F.col("matches") > shown).withColumn("screening", F.lit("screened")), hits.where(F.col("position") <= shown).withColumnRenamed("query_id", "lei")


def get_entity(lei: str, entities: DataFrame, names: DataFrame | None, *, lei_ready: bool = True, sanctions_ready: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """One entity and its hits; NotFound if there is none, NotReady without an entity corpus."""
    check(re.fullmatch(ownership.LEI, lei) is not None, "an identifier has 18 letters or digits and 2 digits")
    if not lei_ready:
        raise NotReady("the entity corpus was never completed")
    one = entities.where(F.col("lei") == lei)
    if one.limit(1).count() == 0:
        raise NotFound(f"no entity {lei}")
    return get_entities(one.select("lei"), one, names, sanctions_ready=sanctions_ready)


def list_sources(designations: DataFrame, entities: DataFrame, edges: DataFrame, states: DataFrame) -> DataFrame:
    """(source, label, records, relationships, ready, as_of): the five lists and the entity registry."""
    ready = merge.readiness(states).select("mirror", "ready", F.col("completed_at").alias("as_of"))
    lists = merge.source_list(designations).select("source", "label", "records", F.lit(None).cast("long").alias("relationships"), F.lit("sanctions").alias("mirror"))
    registry = entities.agg(F.count("*").alias("records")).crossJoin(edges.agg(F.count("*").alias("relationships")))
    registry = registry.select(F.lit("lei").alias("source"), F.lit("Legal entity identifiers").alias("label"), "records", "relationships", F.lit("lei").alias("mirror"))
    got = lists.unionByName(registry).join(F.broadcast(ready), "mirror", "left").drop("mirror")
    return got.withColumn("ready", F.coalesce("ready", F.lit(False)))


def vet(queries: DataFrame, names: DataFrame, entities: DataFrame, edges: DataFrame, *, jurisdiction: str | None = None, depth: int = 3, settings: Settings = Settings()) -> DataFrame:
    """Counterparties (query_id, query) at a glance: hits of the name, the entity it resolves to, and its graph's flags."""
    hits, facts = screen.screen(queries, names, settings)
    best = hits.where("position = 1").select("query_id", F.col("designation_id").alias("top_designation"), F.col("match_type").alias("top_match"))
    matches, _ = resolve.resolve(queries, entities, settings, jurisdiction=jurisdiction)
    chosen = matches.where("position = 1").select("query_id", "lei", F.col("match_type").alias("lei_match"))
    got = ownership.graph(chosen.select(F.col("lei").alias("root")).distinct(), entities, edges, depth=depth, names=names, screen_nodes=True)
    graph = got["facts"].select(F.col("root").alias("lei"), "n_nodes", "flagged_nodes", "complete")
    out = facts.select("query_id", "normalized_query", "mode_used", F.col("total_available").alias("hits")).join(merge.sorted_side(best), "query_id", "left").join(merge.sorted_side(chosen), "query_id", "left").join(merge.sorted_side(graph), "lei", "left")
    return out.withColumn("caveat", F.lit(CAVEAT))
