"""Queries of whole answers, by the entry points that users call: facts of screens, resolution, graphs, entities and vetting."""

from __future__ import annotations

from pyspark.sql import functions as F

from screenlake.config import CAVEAT
from screenlake.operators import ownership, records, resolve, screen
from screenlake.plans import crosswalk as cw
from screenlake.plans.catalog import _ROOT, _SHOW, _TYPO, _TYPOS, HIT, _roots, _sql_entities, query, sql_fuzzy, sql_strict, sql_trace

_FACTS = """SELECT q.query_id, q.folded AS normalized_query, CASE WHEN coalesce(n_strict, 0) = 0 THEN 'fuzzy' ELSE 'strict' END AS mode_used, coalesce(n_strict, 0) = 0 AS fuzzy_fallback, coalesce(n_strict, 0)::INTEGER + coalesce(n_loose, 0)::INTEGER AS total_available,
  CASE WHEN coalesce(n_strict, 0) = 0 THEN 'lower_bound' ELSE 'exact' END AS total_basis FROM q LEFT JOIN (SELECT query_id, count(*) AS n_strict FROM strict GROUP BY 1) USING (query_id) LEFT JOIN (SELECT query_id, count(*) AS n_loose FROM loose GROUP BY 1) USING (query_id)"""


@query(f"WITH {cw.NAME_CTE}, {_TYPO},{sql_strict('typo')},{sql_fuzzy(only='query_id NOT IN (SELECT query_id FROM strict)')} {_FACTS}")
def screen_facts(spark, sf_dir):
    """Strict answers with exact counts, fuzzy ones with lower bounds."""
    return screen.screen(screen.queries_of(spark, _TYPOS), cw.names(spark, sf_dir))[1]


_NAMES = "asked AS (SELECT DISTINCT p_name AS query_id, p_name AS query FROM part)"


def _asked(spark, sf_dir):
    return cw.table(spark, sf_dir, "part").select(F.col("p_name").alias("query_id"), F.col("p_name").alias("query")).distinct()


@query(f"WITH {cw.NAME_CTE}, {_NAMES},{sql_strict('asked', cap=None)} SELECT {_SHOW}, position, total > 15 AS has_more, CASE WHEN total > 15 THEN 15 END AS next_offset FROM ranked WHERE position > 5 AND position <= 15")
def screen_page(spark, sf_dir):
    """The second page of every name's answer, and where the third begins."""
    hits = screen.screen(_asked(spark, sf_dir), cw.names(spark, sf_dir), auto_fallback=False, strict_cap=None)[0]
    return screen.page(hits, limit=10, offset=5).select(*HIT, "position", "has_more", "next_offset")


_LISTED = f"{cw.ENTITY_CTE}, {cw.NAME_CTE}, firm AS (SELECT lei AS query_id, other_names[1] AS query FROM entity),{sql_strict('firm')}"


def _traded(spark, sf_dir):
    """Entities by their trading name, since no legal one is listed."""
    return cw.entities(spark, sf_dir).withColumn("legal_name", F.col("other_names")[0])


@query(f"WITH {_LISTED} SELECT e.lei, e.other_names[1] AS legal_name, e.jurisdiction, e.status, coalesce(n, 0)::INTEGER AS matches, coalesce(n, 0) > 3 AS has_more, 'screened' AS screening FROM entity e LEFT JOIN (SELECT query_id, count(*) AS n FROM strict GROUP BY 1) ON query_id = lei")
def get_entities(spark, sf_dir):
    e = _traded(spark, sf_dir)
    return records.get_entities(e.select("lei"), e, cw.names(spark, sf_dir), shown=3)[0].select("lei", "legal_name", "jurisdiction", "status", "matches", "has_more", "screening")


@query(f"WITH {_LISTED} SELECT query_id AS lei, designation_id, name AS matched_name, match_type, position FROM ranked WHERE position <= 3")
def get_entities_hits(spark, sf_dir):
    e = _traded(spark, sf_dir)
    return records.get_entities(e.select("lei"), e, cw.names(spark, sf_dir), shown=3)[1].select("lei", "designation_id", "matched_name", "match_type", "position")


_MATCH = "query_id, designation_id AS lei, name AS legal_name, match_type, jurisdiction, status, position, total"
MATCH = ["query_id", "lei", "legal_name", "match_type", "jurisdiction", "status", "position", "total"]
_FIRMS = "firms AS (SELECT DISTINCT p_name AS query_id, p_name || ' LLC' AS query FROM part)"


def _firms(spark, sf_dir):
    return cw.table(spark, sf_dir, "part").select(F.col("p_name").alias("query_id"), F.concat("p_name", F.lit(" LLC")).alias("query")).distinct()


@query(f"WITH {cw.ENTITY_CTE}, {_sql_entities('upper(status) = ' + repr('ISSUED'))}, {_FIRMS},{sql_strict('firms', 'chosen', None)} SELECT {_MATCH} FROM ranked")
def bulk_resolve_strict(spark, sf_dir):
    """Every name, without caps."""
    got = resolve.resolve(_firms(spark, sf_dir), cw.entities(spark, sf_dir), strict_cap=None, cap=None, pool_limit=None)[0]
    return got.where("match_type != 'approximate'").select(*MATCH)


@query(f"WITH {cw.ENTITY_CTE}, {_sql_entities('upper(status) <> ' + repr('ISSUED') + ' AND jurisdiction = ' + repr('N10'))}, {_FIRMS},{sql_strict('firms', 'chosen', 2000)} SELECT {_MATCH} FROM ranked")
def resolve_narrowed(spark, sf_dir):
    got = resolve.resolve(_firms(spark, sf_dir), cw.entities(spark, sf_dir), jurisdiction="n10", status="lapsed")[0]
    return got.where("match_type != 'approximate'").select(*MATCH)


_GRAPH = f"WITH RECURSIVE {_ROOT}, {cw.EDGE_CTE}, {cw.ENTITY_CTE}"


@query(
    f"{_GRAPH},{sql_trace('parents', 3)}, seen AS (SELECT n.root, count(*) AS n_nodes, coalesce(string_agg(n.lei, ',' ORDER BY n.lei) FILTER (e.lei IS NULL), '') AS missing_leis FROM node n LEFT JOIN entity e USING (lei) GROUP BY 1) SELECT root, n_nodes, missing_leis, truncated, NOT truncated AND missing_leis = '' AS complete, 'not_requested' AS screening FROM seen JOIN cut USING (root)"
)
def graph_facts(spark, sf_dir):
    """A graph is complete if nothing was cut off and every node has an entity."""
    got = ownership.graph(_roots(spark, sf_dir), cw.entities(spark, sf_dir), cw.relationships(spark, sf_dir), direction="parents", depth=3)["facts"]
    return got.select("root", "n_nodes", F.array_join("missing_leis", ",").alias("missing_leis"), "truncated", "complete", "screening")


@query(f"{_GRAPH},{sql_trace('both', 1)} SELECT root, n.lei, depth::INTEGER AS depth, role, coalesce(legal_name, n.lei) AS legal_name, e.lei IS NULL AS missing, (row_number() OVER (PARTITION BY root ORDER BY depth, n.lei))::INTEGER AS place FROM node n LEFT JOIN entity e USING (lei)")
def graph_nodes(spark, sf_dir):
    got = ownership.graph(_roots(spark, sf_dir), cw.entities(spark, sf_dir), cw.relationships(spark, sf_dir), direction="both", depth=1)["nodes"]
    return got.select("root", "lei", "depth", "role", "legal_name", "missing", "place")


@query(
    f"{_GRAPH}, {cw.NAME_CTE},{sql_trace('parents', 2)}, called AS (SELECT n.root, n.lei, coalesce(e.other_names[1], n.lei) AS legal_name FROM node n LEFT JOIN entity e USING (lei)), ask AS (SELECT DISTINCT legal_name AS query_id, legal_name AS query FROM called),{sql_strict('ask')}, counted AS (SELECT query_id, count(*) AS n FROM strict GROUP BY 1) SELECT root, count(*) AS screened_nodes, count(*) FILTER (n > 0) AS flagged_nodes, 'screened' AS screening FROM called LEFT JOIN counted ON query_id = legal_name GROUP BY 1"
)
def graph_flags(spark, sf_dir):
    got = ownership.graph(_roots(spark, sf_dir), _traded(spark, sf_dir), cw.relationships(spark, sf_dir), direction="parents", depth=2, names=cw.names(spark, sf_dir), screen_nodes=True)["facts"]
    return got.select("root", "screened_nodes", "flagged_nodes", "screening")


@query(
    f"""WITH RECURSIVE {cw.EDGE_CTE}, {cw.ENTITY_CTE}, {cw.NAME_CTE}, {_NAMES},{sql_strict('asked')}, top AS (SELECT query_id, designation_id AS top_designation, match_type AS top_match, total AS hits FROM ranked WHERE position = 1),
  issued AS (SELECT lei, legal_name, normalized, {cw.sql_tokens('normalized')} AS tokens FROM entity WHERE upper(status) = 'ISSUED'), hit AS (SELECT q.query_id, i.lei, i.normalized = q.folded AS exact FROM q JOIN issued i ON list_has_all(i.tokens, q.q_tokens) QUALIFY row_number() OVER (PARTITION BY q.query_id ORDER BY i.lei) <= 2000),
  chosen AS (SELECT query_id, lei, CASE WHEN exact THEN 'exact' ELSE 'strong' END AS lei_match FROM hit QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, lei) = 1), root AS (SELECT DISTINCT lei AS root FROM chosen),{sql_trace('both', 3)},
  named AS (SELECT n.root, n.lei, coalesce(e.legal_name, n.lei) AS legal_name, e.lei IS NULL AS missing FROM node n LEFT JOIN entity e USING (lei)), spelt AS (SELECT DISTINCT legal_name, {cw.sql_tokens(cw.sql_fold('legal_name'))} AS w FROM named),
  flagged AS (SELECT DISTINCT legal_name FROM spelt JOIN names ON list_has_all(names.tokens, w)), graph AS (SELECT root, count(*) AS n_nodes, count(*) FILTER (f.legal_name IS NOT NULL) AS flagged_nodes, NOT bool_or(missing) AS known FROM named LEFT JOIN flagged f USING (legal_name) GROUP BY 1)
  SELECT q.query_id, q.folded AS normalized_query, 'strict' AS mode_used, t.hits, t.top_designation, t.top_match, c.lei, c.lei_match, g.n_nodes, g.flagged_nodes, g.known AND NOT cut.truncated AS complete, '{CAVEAT}' AS caveat
  FROM q JOIN top t USING (query_id) LEFT JOIN chosen c USING (query_id) LEFT JOIN graph g ON g.root = c.lei LEFT JOIN cut ON cut.root = c.lei"""
)
def vet_pipeline(spark, sf_dir):
    """Every name vetted: its hits, the entity it resolves to, and that entity's graph. The SQL is right only where each has a strict hit and a strictly resolved entity, which isn't so on every table."""
    got = records.vet(_asked(spark, sf_dir), cw.names(spark, sf_dir), cw.entities(spark, sf_dir), cw.relationships(spark, sf_dir))
    return got.select("query_id", "normalized_query", "mode_used", "hits", "top_designation", "top_match", "lei", "lei_match", "n_nodes", "flagged_nodes", "complete", "caveat")
