"""A screening corpus derived from the driver's tables, as DataFrames and as DuckDB common table expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from screenlake.config import ENTITY_TYPES, SOURCES
from screenlake.functions.text import fold
from screenlake.operators.merge import sorted_side
from screenlake.operators.names import name_index, screenable
from screenlake.schemas import DESIGNATION, LEI_ENTITY, LEI_RELATIONSHIP, conform

DIRECT, ULTIMATE = "IS_DIRECTLY_CONSOLIDATED_BY", "IS_ULTIMATELY_CONSOLIDATED_BY"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows that are short, but of which much is made, over all cores: a compact file of them is read by few tasks."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)


def _pick(values: tuple[str, ...], i: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (i % len(values) + 1).cast("int"))


def designations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One designation for each part."""
    p = spread(table(spark, sf_dir, "part"), "p_partkey")
    backward = F.concat_ws(" ", F.reverse(F.split("p_name", " ")))
    entry, source = F.col("p_partkey").cast("string"), _pick(SOURCES, F.col("p_partkey"))
    alias = lambda name, kind: F.struct(name.alias("name"), F.lit(kind).alias("name_type"))
    rows = p.select(F.concat_ws(":", source, entry).alias("id"), source.alias("source"), entry.alias("source_entry_id"), _pick(ENTITY_TYPES, F.col("p_size")).alias("entity_type"), F.col("p_name").alias("primary_name"), fold(F.col("p_name")).alias("normalized_name"), F.col("p_brand").alias("program"), F.array(alias(backward, "aka"), alias(F.concat_ws(" ", "p_brand", "p_name"), "low-quality-aka")).alias("aliases"))
    return conform(rows, DESIGNATION)


def names(spark: SparkSession, sf_dir: str, *, with_phonetic: bool = True) -> DataFrame:
    """The name index with what hits show."""
    d = designations(spark, sf_dir)
    return screenable(name_index(d, with_phonetic=with_phonetic), d)


def lei(key: Column) -> Column:
    return F.concat(F.lit("5493"), F.lpad(key.cast("string"), 14, "0"), F.lpad((key % 97).cast("string"), 2, "0"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entity for each customer, named after the part of the same key."""
    c = table(spark, sf_dir, "customer").join(sorted_side(table(spark, sf_dir, "part")), F.col("c_custkey") == F.col("p_partkey"))
    c = c.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    name = F.concat_ws(" ", "p_name", "c_mktsegment", F.lit("LLC"))
    k = F.col("c_custkey")
    rows = c.select(lei(k).alias("lei"), name.alias("legal_name"), fold(name).alias("normalized_name"), F.array(F.concat_ws(" ", "p_brand", "p_name")).alias("other_names"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("jurisdiction"), F.when(k % 10 == 0, "LAPSED").otherwise("ISSUED").alias("status"))
    return conform(rows, LEI_ENTITY)


def relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers own one another by their keys: a tree, a few cycles, a few parents without an entity."""
    k = F.col("c_custkey")
    edge = lambda child, parent, kind: F.struct(lei(child).alias("child_lei"), lei(parent).alias("parent_lei"), F.lit(kind).alias("relationship_type"))
    four, sixteen = F.floor(k / 4), F.floor(k / 16)
    some = F.filter(F.array(edge(k, four, DIRECT), F.when(k >= 16, edge(k, sixteen, ULTIMATE)), F.when(k % 97 == 0, edge(four, k, DIRECT)), F.when(k % 89 == 0, edge(k, k + 10_000_000, DIRECT))), lambda e: e.isNotNull())
    rows = spread(table(spark, sf_dir, "customer"), "c_custkey").where(k >= 1).select(F.explode(some).alias("e")).select("e.*", F.lit("ACTIVE").alias("relationship_status"))
    return conform(rows, LEI_RELATIONSHIP)


def sql_fold(x: str) -> str:
    return f"trim(regexp_replace(lower(strip_accents({x})), '[^a-z0-9]+', ' ', 'g'))"


def sql_tokens(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda t: t <> '')"


def sql_prefixes(x: str) -> str:
    """Distinct prefix keys of a list of tokens, in the order of the tokens."""
    raw = f"list_filter(list_transform({x}, lambda t: substr(t, 1, 3)), lambda p: len(p) >= 2)"
    return f"list_filter({raw}, lambda p, i: list_position({raw}, p) = i)"


_SOURCES = "[" + ", ".join(f"'{s}'" for s in SOURCES) + "]"
_TYPES = "[" + ", ".join(f"'{s}'" for s in ENTITY_TYPES) + "]"
DESIGNATION_CTE = f"""
designation AS (SELECT {_SOURCES}[p_partkey % 5 + 1] || ':' || p_partkey AS id, {_SOURCES}[p_partkey % 5 + 1] AS source, p_partkey::VARCHAR AS source_entry_id,
  {_TYPES}[p_size % 5 + 1] AS entity_type, p_name AS primary_name, p_brand AS program,
  [{{'name': p_name, 'name_type': 'primary'}}, {{'name': array_to_string(list_reverse(string_split(p_name, ' ')), ' '), 'name_type': 'aka'}}, {{'name': p_brand || ' ' || p_name, 'name_type': 'low-quality-aka'}}] AS listed FROM part)"""
NAME_CTE = f"""{DESIGNATION_CTE},
listed AS (SELECT id, unnest(range(0, 3))::INTEGER AS name_ord, unnest(listed) AS n FROM designation),
names AS (SELECT id AS designation_id, name_ord, n.name AS name, {sql_fold("n.name")} AS normalized, {sql_tokens(sql_fold("n.name"))} AS tokens, n.name_type AS name_type,
  source, source_entry_id, entity_type, primary_name, program FROM listed JOIN designation USING (id))"""


def sql_lei(k: str) -> str:
    return f"'5493' || lpad(({k})::VARCHAR, 14, '0') || lpad((({k}) % 97)::VARCHAR, 2, '0')"


ENTITY_CTE = f"""
entity AS (SELECT {sql_lei("c_custkey")} AS lei, p_name || ' ' || c_mktsegment || ' LLC' AS legal_name, {sql_fold("p_name || ' ' || c_mktsegment || ' LLC'")} AS normalized,
  [p_brand || ' ' || p_name] AS other_names, 'N' || n_nationkey AS jurisdiction, CASE WHEN c_custkey % 10 = 0 THEN 'LAPSED' ELSE 'ISSUED' END AS status
  FROM customer JOIN part ON c_custkey = p_partkey JOIN nation ON c_nationkey = n_nationkey)"""
EDGE_CTE = f"""
edge AS (
  SELECT {sql_lei("c_custkey")} AS child_lei, {sql_lei("c_custkey // 4")} AS parent_lei, '{DIRECT}' AS relationship_type FROM customer WHERE c_custkey >= 1
  UNION ALL SELECT {sql_lei("c_custkey")}, {sql_lei("c_custkey // 16")}, '{ULTIMATE}' FROM customer WHERE c_custkey >= 16
  UNION ALL SELECT {sql_lei("c_custkey // 4")}, {sql_lei("c_custkey")}, '{DIRECT}' FROM customer WHERE c_custkey >= 1 AND c_custkey % 97 = 0
  UNION ALL SELECT {sql_lei("c_custkey")}, {sql_lei("c_custkey + 10000000")}, '{DIRECT}' FROM customer WHERE c_custkey >= 1 AND c_custkey % 89 = 0)"""


def sql_jaro(pairs: str, out: str) -> str:
    """CTEs after ``pairs`` (a, b): ``out`` has the distinct pairs with ``jaro`` and ``jw``."""
    low, high = "greatest(0, y.k - x.w)", "least(y.k + x.w + 1, len(x.r))"
    at = f"instr(substr(x.r, ({low} + 1)::INTEGER, greatest(0, {high} - {low})::INTEGER), y.m)"
    step = f"CASE WHEN {at} > 0 THEN {{'r': substr(x.r, 1, ({low} + {at} - 1)::INTEGER) || '_' || substr(x.r, ({low} + {at} + 1)::INTEGER), 'm': x.m || y.m, 'k': x.k, 'w': x.w}} ELSE x END"
    letters = "list_transform(range(0, len(a)), lambda k: {'r': '', 'm': substr(a, (k + 1)::INTEGER, 1), 'k': k, 'w': 0::BIGINT})"
    start = "{'r': b, 'm': '', 'k': 0::BIGINT, 'w': greatest(greatest(len(a), len(b)) // 2 - 1, 0)::BIGINT}"
    same = "list_filter(range(1, least(4, len(a), len(b)) + 1), lambda i: substr(a, i::INTEGER, 1) <> substr(b, i::INTEGER, 1))"
    return f"""
{out}_0 AS (SELECT a, b, list_reduce({letters}, lambda x, y: {step}, {start}) AS s FROM (SELECT DISTINCT a, b FROM {pairs})),
{out}_1 AS (SELECT a, b, s.m AS m, array_to_string(list_transform(list_filter(range(1, len(b) + 1), lambda i: substr(s.r, i::INTEGER, 1) = '_'), lambda i: substr(b, i::INTEGER, 1)), '') AS n FROM {out}_0),
{out}_2 AS (SELECT a, b, len(m)::DOUBLE AS k, len(list_filter(range(1, len(m) + 1), lambda i: substr(m, i::INTEGER, 1) <> substr(n, i::INTEGER, 1))) / 2.0::DOUBLE AS h FROM {out}_1),
{out}_3 AS (SELECT a, b, CASE WHEN a = b THEN 1.0::DOUBLE WHEN k = 0 THEN 0.0::DOUBLE ELSE (k / len(a) + k / len(b) + (k - h) / k) / 3.0::DOUBLE END AS jaro FROM {out}_2),
{out} AS (SELECT a, b, jaro, CASE WHEN jaro = 0 THEN 0.0::DOUBLE ELSE jaro + coalesce(list_min({same}) - 1, least(4, len(a), len(b)))::DOUBLE * 0.1::DOUBLE * (1 - jaro) END AS jw FROM {out}_3)"""


def sql_measures(pool: str, out: str, floor: float) -> str:
    """CTEs after ``pool`` (folded, normalized): ``out`` has whole, token and covered by distinct pair."""
    return f"""
{out}_p AS (SELECT DISTINCT folded, normalized FROM {pool}),
{out}_t AS (SELECT folded, normalized, unnest({sql_tokens("folded")}) AS q, unnest(range(0, len({sql_tokens("folded")}))) AS i FROM {out}_p),
{out}_c AS (SELECT folded, normalized, q, i, unnest({sql_tokens("normalized")}) AS c FROM {out}_t),
{out}_all AS (SELECT folded AS a, normalized AS b FROM {out}_p UNION SELECT q, c FROM {out}_c),{sql_jaro(f"{out}_all", f"{out}_j")},
{out}_best AS (SELECT folded, normalized, i, max(jw) AS best FROM {out}_c JOIN {out}_j ON a = q AND b = c GROUP BY ALL),
{out}_tok AS (SELECT folded, normalized, max(best) AS token, count(*) FILTER (best >= {floor}) AS covered FROM {out}_best GROUP BY ALL),
{out} AS (SELECT p.folded, p.normalized, jw AS whole, coalesce(token, 0) AS token, coalesce(covered, 0)::INTEGER AS covered
  FROM {out}_p p JOIN {out}_j ON a = p.folded AND b = p.normalized LEFT JOIN {out}_tok t ON t.folded = p.folded AND t.normalized = p.normalized)"""


def sql_admitted(floor: float) -> str:
    return f"((whole >= {floor} AND least(len(folded), len(normalized)) / greatest(len(folded), len(normalized), 1) >= 0.5) OR (token >= {floor} AND covered * 2 >= n_tokens))"


def sql_phonetic(words: str, out: str) -> str:
    """CTEs after ``words`` (word): ``out`` (word, key) by the table of rules, one letter a step. A pattern that excludes something is two, one of which must not match."""
    from screenlake.functions import phonetic as ph

    def parted(text: str) -> tuple[str, str]:
        """(what must match, what must not): without look-ahead, which the SQL engine hasn't."""
        got = re.search(r"\(\?!([^)]*)\)", text)
        return (text.replace(got[0], ""), text[: got.start()] + got[1]) if got else (text, "")

    rows = []

    def add(letter: str, rules: list, when: str = "") -> None:
        for ahead, behind, code, used in rules:
            yes, no = parted(ahead.pattern)
            back = "" if behind is None else behind.pattern
            back, back_no = {"(?:(?<!WI))$": ("", "WI$"), "(?:^(?!M$).*)$": ("", "^M$")}.get(back, (back, ""))
            rows.append((letter, len(rows), when, f"^(?:{yes})", f"^(?:{no})" if no else "", back, back_no, code, used))

    for letter, rules in ph._TABLE.items():
        add(letter, rules)
    for rules, when in ((ph._G, ""), (ph._GN, "plain"), (ph._GN_SLAVIC, "slavic"), (ph._G_REST, ""), (ph._G_SOFT, "soft"), (ph._G_LAST, "")):
        add("G", rules, when)
    values = ", ".join("(" + ", ".join(str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'" for v in r) + ")" for r in rows)
    unit = "substr(s, pos + 1)"
    before = "substr(s, 1, pos)"
    return f"""
{out}_rules(letter, ord, cond, ahead, ahead_no, behind, behind_no, code, used) AS (VALUES {values}),
{out}_word AS (SELECT word, s, regexp_matches(s, 'W|K|CZ') AS slavic, regexp_matches(s, '^[DRM]ANGER') AS hard FROM (SELECT DISTINCT word, regexp_replace(upper(word), '[^A-Z]', '', 'g') AS s FROM {words})),
{out}_walk AS (SELECT word, s, slavic, hard, CASE WHEN s[1] = 'X' OR regexp_matches(s, '^(GN|KN|PN|WR|PS)') THEN 1 ELSE 0 END AS pos, CASE WHEN s[1] = 'X' THEN 'S' ELSE '' END AS key FROM {out}_word
  UNION ALL SELECT word, s, slavic, hard, pos + coalesce(used, 1), key || coalesce(code, '') FROM (
    SELECT w.*, r.used, r.code, row_number() OVER (PARTITION BY word ORDER BY r.ord) AS nth FROM {out}_walk w LEFT JOIN {out}_rules r ON r.letter = substr(s, pos + 1, 1) AND regexp_matches({unit}, r.ahead)
      AND (r.ahead_no = '' OR NOT regexp_matches({unit}, r.ahead_no)) AND (r.behind = '' OR regexp_matches({before}, r.behind)) AND (r.behind_no = '' OR NOT regexp_matches({before}, r.behind_no))
      AND (r.cond = '' OR (r.cond = 'plain' AND NOT slavic) OR (r.cond = 'slavic' AND slavic) OR (r.cond = 'soft' AND NOT hard AND substr(s, greatest(pos, 1)::BIGINT, CASE WHEN pos = 0 THEN 2 ELSE 3 END) NOT IN ('RGY', 'OGY')))
    WHERE pos < len(s)) WHERE nth = 1),
{out} AS (SELECT word, replace(key, '-', '') AS key FROM {out}_walk WHERE pos >= len(s))"""
