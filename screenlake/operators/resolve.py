"""Company names to legal-entity identifiers, for any number of queries at once.

Strict matches and fuzzy blocking look at the legal name; a pooled entity is scored by all of its names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from screenlake.config import Settings, check
from screenlake.functions.text import fold, tokens
from screenlake.operators import screen
from screenlake.operators.merge import sorted_side

SHOWN = ["legal_name", "jurisdiction", "status"]


def narrowed(entities: DataFrame, jurisdiction: str | None = None, status: str = "issued") -> DataFrame:
    """Entities of one jurisdiction, and with an issued, a lapsed (any other known) or any status."""
    check(status in ("issued", "lapsed", "any"), "status is issued, lapsed or any")
    if jurisdiction:
        entities = entities.where(F.col("jurisdiction") == jurisdiction.upper())
    issued = F.upper("status") == "ISSUED"
    return entities if status == "any" else entities.where(issued if status == "issued" else ~issued)


def _as_names(entities: DataFrame) -> DataFrame:
    """Legal names in the form of the name index."""
    return entities.select(F.col("lei").alias("designation_id"), F.lit(0).alias("name_ord"), F.col("normalized_name").alias("normalized"), tokens(F.col("normalized_name")).alias("tokens"), "other_names", *SHOWN)


def strict(q: DataFrame, entities: DataFrame, cap: int | None = Settings.lei_cap) -> DataFrame:
    hits = screen.strict_rows(q, _as_names(entities), cap)
    return hits.select("query_id", F.col("designation_id").alias("lei"), *SHOWN, F.col("legal_name").alias("matched_name"), F.when(F.col("exact"), "exact").otherwise("strong").alias("match_type"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("int").alias("covered"), F.lit(None).cast("int").alias("n_tokens"), "capped")


def fuzzy(q: DataFrame, entities: DataFrame, settings: Settings = Settings(), *, min_score: float | None = None, cap: int | None = -1, pool_limit: int | None = -1) -> DataFrame:
    """Each pooled entity by its best admitted name: the unrounded score first, then covered tokens, then list order."""
    floor = settings.min_score if min_score is None else min_score
    cap = settings.max_fuzzy if cap == -1 else cap
    # Only what is compared goes through blocking; what is shown comes back to the rows that are left.
    every = _as_names(entities)
    slim = every.select("designation_id", "name_ord", "normalized")
    pool = screen.candidates(q, slim, settings.pool_limit if pool_limit == -1 else pool_limit, with_phonetic=False)
    pool = pool.select("query_id", "arm", "designation_id").join(sorted_side(every.drop("name_ord", "normalized", "tokens")), "designation_id")
    listed = F.concat(F.array("legal_name"), F.coalesce("other_names", F.array().cast("array<string>")))
    named = pool.select("*", F.posexplode(listed).alias("name_ord", "name")).withColumn("normalized", fold(F.col("name")))
    rows = screen.scored(q, named, floor)
    best = Window.partitionBy("query_id", "designation_id").orderBy(F.desc("raw"), F.desc("covered"), "name_ord")
    rows = rows.withColumn("best", F.row_number().over(best)).where("best = 1")
    if cap is not None:
        top = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("covered"), "designation_id")
        rows = rows.withColumn("place", F.row_number().over(top)).where(F.col("place") <= cap)
    return rows.select("query_id", F.col("designation_id").alias("lei"), *SHOWN, F.col("name").alias("matched_name"), F.lit("approximate").alias("match_type"), "score", "covered", "n_tokens", F.lit(True).alias("capped"))


def resolve(queries: DataFrame, entities: DataFrame, settings: Settings = Settings(), *, match_mode: str = "strict", jurisdiction: str | None = None, status: str = "issued", min_score: float | None = None, **caps: int | None) -> tuple[DataFrame, DataFrame]:
    """(all matches by query and position, one row of facts for each query); without strict matches fuzzy ones."""
    check(match_mode in ("strict", "fuzzy"), "match_mode is strict or fuzzy")
    entities = narrowed(entities, jurisdiction, status)
    q = screen.prepared(queries)
    firm = strict(q, entities, caps.pop("strict_cap", settings.lei_cap))
    loose_q = q if match_mode == "fuzzy" else q.join(firm.select("query_id").distinct(), "query_id", "left_anti")
    loose = fuzzy(loose_q, entities, settings, min_score=min_score, **caps)
    every = firm.unionByName(loose.join(firm.select("query_id", "lei"), ["query_id", "lei"], "left_anti"))
    hits = screen.ranked(every.withColumnRenamed("lei", "designation_id")).withColumnRenamed("designation_id", "lei")
    counts = hits.groupBy("query_id").agg(F.count("*").alias("n"), F.max("capped").alias("capped"), F.sum(F.when(F.col("match_type") != "approximate", 1).otherwise(0)).alias("n_strict"))
    facts = q.join(counts, "query_id", "left")
    was_fuzzy = (F.lit(match_mode == "fuzzy") | (F.coalesce("n_strict", F.lit(0)) == 0)) & (F.size("q_tokens") > 0)
    facts = facts.select("query_id", F.col("folded").alias("normalized_query"), F.when(was_fuzzy, "fuzzy").otherwise("strict").alias("mode_used"), (was_fuzzy & F.lit(match_mode == "strict")).alias("fuzzy_fallback"), F.coalesce("n", F.lit(0)).cast("int").alias("total_available"), F.when(was_fuzzy | F.coalesce("capped", F.lit(False)), "lower_bound").otherwise("exact").alias("total_basis"))
    return hits.drop("capped"), facts


def page(matches: DataFrame, limit: int = 25, offset: int = 0) -> DataFrame:
    """Matches of each query from ``offset``, at most 50."""
    return screen.page(matches.withColumnRenamed("lei", "designation_id"), limit, offset, most=50).withColumnRenamed("designation_id", "lei")
