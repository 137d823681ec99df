"""Queries of ingest: markup is rendered from the driver's tables in the shape of each feed and read back, with SQL that never saw it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenlake.config import SOURCES, sources_table
from screenlake.functions import normalise
from screenlake.functions.text import blank_to_null
from screenlake.operators import merge
from screenlake.plans import crosswalk as cw
from screenlake.plans.catalog import query
from screenlake.schemas import LEI_ENTITY, LEI_RELATIONSHIP, MIRROR_STATE, conform
from screenlake.sources import feeds, lei, lists



def _k() -> Column:
    return F.col("p_partkey")


def _c() -> Column:
    return F.col("c_custkey")


def _el(tag: str, *inner: Column | str) -> Column:
    return F.concat(F.lit(f"<{tag}>"), *(F.lit(x) if isinstance(x, str) else x for x in inner), F.lit(f"</{tag}>"))


def _if(when: Column, what: Column) -> Column:
    return F.when(when, what).otherwise("")


def _at(values: tuple[str, ...], i: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (i % len(values) + 1).cast("int"))


def _sql_at(values: tuple[str, ...], i: str) -> str:
    return "([" + ", ".join(f"'{v}'" for v in values) + f"])[({i}) % {len(values)} + 1]"


def _names(df: DataFrame) -> Column:
    return F.array_join(F.transform("aliases", lambda a: F.concat_ws("=", a["name"], a["name_type"])), ";").alias("aliases")


def _dated() -> Column:
    return F.array_join(F.transform("dates_of_birth", lambda d: F.concat_ws("@", F.coalesce(d["date"], F.lit("?")), d["place"])), ";").alias("births")


FIRST, LAST = "split_part(p_name, ' ', 1)", "split_part(p_name, ' ', 2)"
_SDN_TYPES = ("Individual", "ENTITY", " vessel ", "Aircraft", "Other")
_TYPES = ("person", "organization", "vessel", "aircraft", "unknown")

def _parts(spark, sf_dir) -> DataFrame:
    return cw.spread(cw.table(spark, sf_dir, "part"), "p_partkey")


# The standard feed


def _standard(spark, sf_dir) -> lists.Reader:
    p = _parts(spark, sf_dir)
    first, last = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    entry = _el(
        "sdnEntry", _if(_k() % 11 != 0, _el("uid", F.lit(" "), _k().cast("string"))), _if(_k() % 3 != 0, _el("firstName", first)), _if(_k() % 7 != 0, _el("lastName", last)), _el("sdnType", _at(_SDN_TYPES, F.col("p_size"))),
        F.when(_k() % 2 == 0, _el("programList", _el("program", F.col("p_brand")), _el("program", "LATER"))).otherwise(_el("program", F.col("p_type"))), _el("remarks", F.concat(F.lit("Seen "), F.when(_k() % 4 == 0, F.lit("3 Mar 2001")).when(_k() % 4 == 1, F.lit("2002-05-06")).otherwise("never"))),
        _el("akaList", _el("aka", _el("category", "strong"), _el("lastName", F.col("p_brand"))), _el("aka", _el("category", " Weak"), _el("firstName", last), _el("lastName", first))),
        _el("idList", _el("id", _el("idType", "Passport"), _el("idNumber", F.concat(F.lit("00"), _k())), _el("idCountry", "X")), _el("id", _el("idType", "empty")), _el("id", _el("idNumber", "7"))),
        _el("addressList", _el("address", _el("address1", F.col("p_brand")), _el("city", "Town"), _el("country", "Land")), _el("address", _el("city", " "))), _el("dateOfBirthList", _el("dateOfBirthItem", _el("dateOfBirth", "circa 1960"))), _el("nationalityList", _el("nationality", _el("country", F.col("p_type")))),
    )
    return lists.column(p.select(_el("sdnList", entry).alias("x")), "x")


_STANDARD_SQL = f"""e AS (SELECT *, CASE WHEN p_partkey % 11 <> 0 THEN p_partkey::VARCHAR END AS entry,
  nullif(concat_ws(' ', CASE WHEN p_partkey % 3 <> 0 THEN {FIRST} END, CASE WHEN p_partkey % 7 <> 0 THEN {LAST} END), '') AS named FROM part)"""


@query(
    f"""WITH {_STANDARD_SQL} SELECT 'ofac_sdn:' || entry AS id, {_sql_at(_TYPES, 'p_size')} AS entity_type, named AS primary_name, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_type END AS program,
  CASE p_partkey % 4 WHEN 0 THEN '3 Mar 2001' WHEN 1 THEN '2002-05-06' END AS designation_date, p_brand || '=aka;' || {LAST} || ' ' || {FIRST} || '=low-quality-aka' AS aliases,
  'Passport:00' || p_partkey || ':X;ID:7' AS identifiers, p_brand || ', Town, Land' AS address, 'circa 1960' AS births, p_type AS nationality FROM e WHERE entry IS NOT NULL AND named IS NOT NULL"""
)
def ingest_ofac_standard(spark, sf_dir):
    d = lists.ofac_standard(_standard(spark, sf_dir))[0]
    ids = F.array_join(F.transform("identifiers", lambda i: F.concat_ws(":", i["type"], i["value"], i["country"])), ";").alias("identifiers")
    return d.select("id", "entity_type", "primary_name", "program", "designation_date", _names(d), ids, F.array_join(F.transform("addresses", lambda a: a["full"]), ";").alias("address"), _dated(), F.array_join("nationalities", ";").alias("nationality"))


@query(f"WITH {_STANDARD_SQL} SELECT 'ofac_sdn' AS source, CASE WHEN entry IS NULL THEN 'missing_identifier' WHEN named IS NULL THEN 'unusable_name' ELSE 'accepted' END AS outcome, count(*) AS n FROM e GROUP BY ALL")
def ingest_ofac_standard_counts(spark, sf_dir):
    """Through the registry, which tells the feed by its records."""
    return lists.harvest({"ofac_sdn": _standard(spark, sf_dir)})[1].select("source", "outcome", "n")


# The advanced feed: references, parties, and entries that come after them


_PARTIES = (("1", "Unknown"), ("2", "Unknown"), ("4", "Vessel"), ("2", "Aircraft"), ("9", "Other"))
_LINKS = ("A.K.A.", "F.K.A.", "N.K.A.")


def _advanced(spark, sf_dir) -> lists.Reader:
    p = _parts(spark, sf_dir)
    labels = lambda tag, values: "".join(f'<{tag} ID="{i}">{v}</{tag}>' for i, v in enumerate(values))
    kinds = "".join(f'<PartySubType ID="{i}" PartyTypeID="{a}">{b}</PartySubType>' for i, (a, b) in enumerate(_PARTIES))
    refs = f"<ReferenceValueSets><AliasTypeValues>{labels('AliasType', _LINKS)}</AliasTypeValues><FeatureTypeValues>{labels('FeatureType', ('Birthdate', 'Place of Birth', 'Height'))}</FeatureTypeValues><PartySubTypeValues>{kinds}</PartySubTypeValues></ReferenceValueSets>"
    part = lambda x: _el("DocumentedNamePart", _el("NamePartValue", x))
    alias = lambda kind, flags, *parts: F.concat(F.lit('<Alias AliasTypeID="'), kind, F.lit(f'" {flags}>'), _el("DocumentedName", *map(part, parts)), F.lit("</Alias>"))
    first, last = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    born = F.concat(F.lit('<Feature FeatureTypeID="0"><FeatureVersion><DatePeriod><Start><From>'), _el("Year", F.concat(F.lit("19"), F.lpad(F.col("p_size").cast("string"), 2, "0"))), _if(_k() % 2 == 0, _el("Month", (_k() % 12 + 1).cast("string"))), _if(_k() % 4 == 0, _el("Day", (_k() % 28 + 1).cast("string"))), F.lit("</From></Start></DatePeriod></FeatureVersion></Feature>"))
    where = F.concat(F.lit('<Feature FeatureTypeID="1"><FeatureVersion>'), _el("VersionDetail", F.col("p_type")), F.lit("</FeatureVersion></Feature>"))
    profile = F.concat(
        F.lit('<Profile PartySubTypeID="'), (F.col("p_size") % 5).cast("string"), F.lit('"><Identity>'), alias((_k() % 3).cast("string"), 'Primary="false" LowQuality="false"', F.col("p_brand")), alias(F.lit("0"), 'Primary="false" LowQuality="true"', last),
        _if(_k() % 5 != 0, alias(F.lit("0"), 'Primary="true" LowQuality="false"', first, last)), F.lit("</Identity>"), _if(_k() % 3 != 0, born), _if(_k() % 2 == 0, where), F.lit('<Feature FeatureTypeID="2"><FeatureVersion><VersionDetail>tall</VersionDetail></FeatureVersion></Feature></Profile>'),
    )
    party = F.concat(F.lit('<DistinctParty FixedRef="'), _k().cast("string"), F.lit('">'), profile, F.lit("</DistinctParty>"))
    entry = lambda n, inner: F.concat(F.lit('<SanctionsEntry ID="'), (2 * _k() + n).cast("string"), F.lit('" ProfileID="'), _k().cast("string"), F.lit('">'), inner, F.lit("</SanctionsEntry>"))
    measure = lambda x: _el("SanctionsMeasure", _el("Comment", x))
    one = entry(0, F.concat(_el("EntryEvent", _el("Date", _el("Year", "2001"), _el("Month", "2"), _el("Day", "3"))), measure(F.col("p_brand")), measure(F.col("p_type"))))
    two = entry(1, F.when(_k() % 4 == 0, measure(F.lit("NEW"))).otherwise(_el("EntryEvent", _el("Date", _el("Year", "2009")))))
    rows = p.select(F.concat(party, _if(_k() % 7 != 0, one), _if(_k() % 2 == 0, two)).alias("x"))
    return lists.column(rows.unionByName(spark.createDataFrame([(refs,)], "x string")), "x")


_PLACE = "CASE WHEN p_partkey % 2 = 0 THEN p_type END"
_BORN = "CASE WHEN p_partkey % 3 <> 0 THEN '19' || lpad(p_size::VARCHAR, 2, '0') || CASE WHEN p_partkey % 2 = 0 THEN '-' || lpad((p_partkey % 12 + 1)::VARCHAR, 2, '0') ELSE '' END || CASE WHEN p_partkey % 4 = 0 THEN '-' || lpad((p_partkey % 28 + 1)::VARCHAR, 2, '0') ELSE '' END END"
_LINKED = f"p_brand || '=' || CASE p_partkey % 3 WHEN 1 THEN 'fka' ELSE 'aka' END"


@query(
    f"""SELECT 'ofac_sdn:' || p_partkey AS id, {_sql_at(('person', 'organization', 'vessel', 'aircraft', 'unknown'), 'p_size')} AS entity_type, CASE WHEN p_partkey % 5 <> 0 THEN p_name ELSE p_brand END AS primary_name,
  CASE WHEN p_partkey % 5 <> 0 THEN {_LINKED} || ';' ELSE '' END || {LAST} || '=low-quality-aka' AS aliases,
  CASE WHEN p_partkey % 4 = 0 THEN 'NEW' WHEN p_partkey % 7 <> 0 THEN p_brand || ', ' || p_type END AS program, CASE WHEN p_partkey % 4 = 2 THEN '2009' WHEN p_partkey % 7 <> 0 THEN '2001-02-03' END AS designation_date,
  CASE WHEN {_BORN} IS NULL AND {_PLACE} IS NULL THEN '' ELSE concat_ws('@', coalesce({_BORN}, '?'), {_PLACE}) END AS births FROM part"""
)
def ingest_ofac_advanced(spark, sf_dir):
    """Names, kinds, births and places by the feed's own reference lists; programmes and dates joined from the entries at its end."""
    d = lists.harvest({"ofac_sdn": _advanced(spark, sf_dir)})[0]
    return d.select("id", "entity_type", "primary_name", _names(d), "program", "designation_date", _dated())


@query("SELECT 'alias' AS kind, count(*) AS n FROM (VALUES (1), (2), (3)) UNION ALL SELECT 'feature', 3 UNION ALL SELECT 'subtype', 5")
def ingest_references(spark, sf_dir):
    refs = lists.ofac_references(_advanced(spark, sf_dir))
    return refs["alias"].select(F.lit("alias").alias("kind")).unionByName(refs["feature"].select(F.lit("feature").alias("kind"))).unionByName(refs["subtype"].select(F.lit("subtype").alias("kind"))).groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT p_partkey::VARCHAR AS source_entry_id, CASE WHEN p_partkey % 4 = 0 THEN 'NEW' WHEN p_partkey % 7 <> 0 THEN p_brand || ', ' || p_type END AS program, CASE WHEN p_partkey % 4 = 2 THEN '2009' WHEN p_partkey % 7 <> 0 THEN '2001-02-03' END AS designation_date FROM part WHERE p_partkey % 7 <> 0 OR p_partkey % 2 = 0")
def ingest_deferred_programs(spark, sf_dir):
    return lists.ofac_deferred(_advanced(spark, sf_dir), "ofac_sdn").select("source_entry_id", "program", "designation_date")


# The other lists


def _eu(spark, sf_dir) -> lists.Reader:
    attr = lambda name, value: F.concat(F.lit(f' {name}="'), value, F.lit('"'))
    rule = F.concat(F.lit("<regulation"), attr("programme", F.col("p_brand")), attr("publicationDate", F.lit("2003-07-08")), F.lit("/>"))
    x = F.concat(
        F.lit("<sanctionEntity"), _if(_k() % 3 != 0, attr("logicalId", _k().cast("string"))), _if(_k() % 3 == 0, attr("euReferenceNumber", F.concat(F.lit("EU."), _k()))), F.lit(">"), rule, _if(_k() % 4 == 0, rule), F.lit("<subjectType"), attr("code", _at(("person", "E", "p", "enterprise", "x"), F.col("p_size"))), F.lit("/>"),
        F.lit("<nameAlias"), attr("wholeName", F.when(_k() % 5 == 0, F.lit("  ")).otherwise(F.col("p_name"))), attr("firstName", F.col("p_type")), attr("lastName", F.col("p_brand")), attr("strong", F.lit("true")), F.lit("/><nameAlias"), attr("wholeName", F.col("p_brand")), attr("strong", F.when(_k() % 2 == 0, "false").otherwise("true")), F.lit("/>"),
        F.lit("<birthdate"), attr("birthdate", F.lit("1937-04-28")), F.lit("/><citizenship"), attr("countryDescription", F.col("p_type")), F.lit("/></sanctionEntity>"),
    )
    return lists.column(_parts(spark, sf_dir).select(_el("export", x).alias("x")), "x")


@query(
    f"""SELECT 'eu:' || CASE WHEN p_partkey % 3 = 0 THEN 'EU.' ELSE '' END || p_partkey AS id, {_sql_at(('person', 'organization', 'person', 'organization', 'unknown'), 'p_size')} AS entity_type, CASE WHEN p_partkey % 5 = 0 THEN p_type || ' ' || p_brand ELSE p_name END AS primary_name,
  p_brand || CASE WHEN p_partkey % 2 = 0 THEN '=low-quality-aka' ELSE '=aka' END AS aliases, CASE WHEN p_partkey % 4 <> 0 THEN p_brand END AS program, CASE WHEN p_partkey % 4 <> 0 THEN '2003-07-08' END AS designation_date, '1937-04-28' AS births, p_type AS nationality FROM part"""
)
def ingest_eu(spark, sf_dir):
    d = lists.eu(_eu(spark, sf_dir))[0]
    return d.select("id", "entity_type", "primary_name", _names(d), "program", "designation_date", _dated(), F.array_join("nationalities", ";").alias("nationality"))


def _uk(spark, sf_dir) -> lists.Reader:
    first, last = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    listed = _el("Name", _el("Name1", first), _el("Name6", last), _el("NameType", "Primary Name"))
    other = _el("Name", _el("WholeName", F.col("p_brand")))
    x = _el(
        "Designation", _if(_k() % 3 == 0, _el("UniqueID", F.concat(F.lit("U"), _k()))), _if(_k() % 3 != 0, _el("OFSIGroupID", _k().cast("string"))), _if(_k() % 2 == 0, _el("DateDesignated", "01/02/2003")), _el("LastUpdated", "2020"), _el("RegimeName", F.col("p_type")), _el("IndividualEntityShip", _at(("Individual", "Entity", "Ship", "Organisation", "x"), F.col("p_size"))),
        F.when(_k() % 7 == 0, _el("Names", _el("WholeName", F.col("p_brand")))).otherwise(_el("Names", listed, other)), _el("Nationalities", _el("Nationality", "A"), _el("Nationality", " "), _el("Nationality", "B")), _el("OtherInformation", F.col("p_brand")),
    )
    return lists.column(_parts(spark, sf_dir).select(_el("Designations", x).alias("x")), "x")


@query(
    f"""SELECT 'uk:' || CASE WHEN p_partkey % 3 = 0 THEN 'U' ELSE '' END || p_partkey AS id, {_sql_at(('person', 'organization', 'vessel', 'organization', 'unknown'), 'p_size')} AS entity_type, CASE WHEN p_partkey % 7 = 0 THEN p_brand ELSE p_name END AS primary_name,
  CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_brand || '=aka' END AS aliases, p_type AS program, CASE WHEN p_partkey % 2 = 0 THEN '01/02/2003' ELSE '2020' END AS designation_date, 'A;B' AS nationality, p_brand AS remarks FROM part"""
)
def ingest_uk(spark, sf_dir):
    d = lists.uk(_uk(spark, sf_dir))[0]
    return d.select("id", "entity_type", "primary_name", _names(d), "program", "designation_date", F.array_join("nationalities", ";").alias("nationality"), "remarks")


def _un(spark, sf_dir) -> lists.Reader:
    first, last = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    person = F.concat(_el("FIRST_NAME", first), _el("SECOND_NAME", last), _el("INDIVIDUAL_ALIAS", _el("QUALITY", "Low"), _el("ALIAS_NAME", F.col("p_brand"))), _el("INDIVIDUAL_DATE_OF_BIRTH", _if(_k() % 4 == 0, _el("DATE", "1960-01-02")), _el("YEAR", "1971")), _el("INDIVIDUAL_DOCUMENT", _el("NUMBER", F.concat(F.lit("0"), _k()))), _el("INDIVIDUAL_DOCUMENT", _el("TYPE_OF_DOCUMENT", "none")))
    firm = F.concat(_el("FIRST_NAME", F.when(_k() % 9 == 0, F.lit("bad �")).otherwise(F.col("p_name"))), _el("ENTITY_ALIAS", _el("QUALITY", "a.k.a."), _el("ALIAS_NAME", F.col("p_brand"))))
    shared = F.concat(_if(_k() % 11 != 0, _el("DATAID", _k().cast("string"))), _el("UN_LIST_TYPE", F.col("p_type")), _el("LISTED_ON", "2012-12-31"), _el("NATIONALITY", _el("VALUE", "Land")), _el("COMMENTS1", F.col("p_brand")))
    x = F.when(_k() % 2 == 0, _el("INDIVIDUAL", shared, person)).otherwise(_el("ENTITY", shared, firm))
    return lists.column(_parts(spark, sf_dir).select(_el("CONSOLIDATED_LIST", x).alias("x")), "x")


_UN_FINE = "p_partkey % 11 <> 0 AND NOT (p_partkey % 2 = 1 AND p_partkey % 9 = 0)"


@query(
    f"""SELECT 'un:' || p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'person' ELSE 'organization' END AS entity_type, p_name AS primary_name, p_brand || CASE WHEN p_partkey % 2 = 0 THEN '=low-quality-aka' ELSE '=aka' END AS aliases, p_type AS program, '2012-12-31' AS designation_date,
  CASE WHEN p_partkey % 4 = 0 THEN '1960-01-02' WHEN p_partkey % 2 = 0 THEN '1971' ELSE '' END AS births, CASE WHEN p_partkey % 2 = 0 THEN 'Document:0' || p_partkey ELSE '' END AS identifiers, p_brand AS remarks FROM part WHERE {_UN_FINE}"""
)
def ingest_un(spark, sf_dir):
    """Individuals and entities, one list."""
    d = lists.un(_un(spark, sf_dir))[0]
    return d.select("id", "entity_type", "primary_name", _names(d), "program", "designation_date", _dated(), F.array_join(F.transform("identifiers", lambda i: F.concat_ws(":", i["type"], i["value"])), ";").alias("identifiers"), "remarks")


@query(
    f"""WITH {_STANDARD_SQL}, every AS (SELECT 'ofac_sdn' AS source, 'accepted' AS outcome FROM part
  UNION ALL SELECT 'ofac_consolidated', CASE WHEN entry IS NULL THEN 'missing_identifier' WHEN named IS NULL THEN 'unusable_name' ELSE 'accepted' END FROM e
  UNION ALL SELECT 'eu', 'accepted' FROM part UNION ALL SELECT 'uk', 'accepted' FROM part
  UNION ALL SELECT 'un', CASE WHEN p_partkey % 11 = 0 THEN 'missing_identifier' WHEN {_UN_FINE} THEN 'accepted' ELSE 'unusable_name' END FROM part)
  SELECT source, outcome, count(*) AS n FROM every GROUP BY ALL"""
)
def ingest_all_counts(spark, sf_dir):
    """All five sources in one harvest, one of them in the standard form."""
    readers = {"ofac_sdn": _advanced(spark, sf_dir), "ofac_consolidated": _standard(spark, sf_dir), "eu": _eu(spark, sf_dir), "uk": _uk(spark, sf_dir), "un": _un(spark, sf_dir)}
    return lists.harvest(readers)[1].select("source", "outcome", "n")


@query(
    f"""WITH {_STANDARD_SQL} SELECT source, count(*) AS n FROM (SELECT 'ofac_sdn' AS source FROM part UNION ALL SELECT 'ofac_consolidated' FROM e WHERE entry IS NOT NULL AND named IS NOT NULL
  UNION ALL SELECT 'eu' FROM part UNION ALL SELECT 'uk' FROM part UNION ALL SELECT 'un' FROM part WHERE {_UN_FINE}) GROUP BY ALL"""
)
def ingest_all_sources(spark, sf_dir):
    readers = {"ofac_sdn": _advanced(spark, sf_dir), "ofac_consolidated": _standard(spark, sf_dir), "eu": _eu(spark, sf_dir), "uk": _uk(spark, sf_dir), "un": _un(spark, sf_dir)}
    return lists.harvest(readers)[0].groupBy("source").agg(F.countDistinct("id").alias("n"))


# The registry of legal entities



def _customers(spark, sf_dir) -> DataFrame:
    c = cw.spread(cw.table(spark, sf_dir, "customer"), "c_custkey")
    return c.join(cw.table(spark, sf_dir, "nation"), c["c_nationkey"] == F.col("n_nationkey"))


def _level1(spark, sf_dir) -> lists.Reader:
    where = lambda tag: _el(tag, _el("lei:FirstAddressLine", F.col("c_name")), _el("lei:AdditionalAddressLine", "Floor 2"), _el("lei:City", F.col("n_name")), _el("lei:Region", " "), _el("lei:PostalCode", _c().cast("string")), _el("lei:Country", "XX"))
    entity = _el(
        "lei:Entity", F.concat(F.lit('<lei:LegalName xml:lang="en">'), F.when(_c() % 13 == 0, "  ").otherwise(F.concat_ws(" ", "c_name", "c_mktsegment")), F.lit("</lei:LegalName>")), _el("lei:OtherEntityNames", F.lit('<lei:OtherEntityName type="x">'), F.col("c_mktsegment"), F.lit("</lei:OtherEntityName>"), _el("lei:OtherEntityName", "bad �")),
        _el("lei:LegalJurisdiction", F.concat(F.lit("N"), F.col("n_nationkey"))), where("lei:LegalAddress"), _if(_c() % 2 == 0, where("lei:HeadquartersAddress")), _el("lei:RegistrationAuthority", _el("lei:RegistrationAuthorityID", "RA1"), _el("lei:RegistrationAuthorityEntityID", _c().cast("string"))), _el("lei:EntityStatus", "ACTIVE"),
    )
    x = _el("lei:LEIRecord", _if(_c() % 17 != 0, _el("lei:LEI", cw.lei(_c()))), entity, _el("lei:Registration", _if(_c() % 3 != 0, _el("lei:RegistrationStatus", "LAPSED")), _el("lei:LastUpdateDate", "2024-01-02")))
    return lists.column(_customers(spark, sf_dir).select(F.concat(F.lit('<lei:LEIData xmlns:lei="urn:l">'), x, F.lit("</lei:LEIData>")).alias("x")), "x")


_WHERE = "c_name || ', Floor 2, ' || n_name || ', ' || c_custkey || ', XX'"
_NAMED = "c_name || ' ' || c_mktsegment"
LEVEL1_SQL = f"""level1 AS (SELECT {cw.sql_lei("c_custkey")} AS lei, {_NAMED} AS legal_name, {cw.sql_fold(_NAMED)} AS normalized_name, c_mktsegment AS other_names, 'N' || n_nationkey AS jurisdiction, CASE WHEN c_custkey % 3 <> 0 THEN 'LAPSED' ELSE 'ACTIVE' END AS status,
  {_WHERE} AS legal_address, CASE WHEN c_custkey % 2 = 0 THEN {_WHERE} END AS headquarters_address, 'RA1:' || c_custkey AS authority, '2024-01-02' AS last_update FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 17 <> 0 AND c_custkey % 13 <> 0)"""


@query(f"WITH {LEVEL1_SQL} SELECT * FROM level1")
def ingest_lei_level1(spark, sf_dir):
    e = lei.entities(_level1(spark, sf_dir))[0]
    return e.select("lei", "legal_name", "normalized_name", F.array_join("other_names", ";").alias("other_names"), "jurisdiction", "status", "legal_address", "headquarters_address", F.concat_ws(":", "registration_authority_id", "registration_authority_entity_id").alias("authority"), "last_update")


@query("SELECT CASE WHEN c_custkey % 17 = 0 THEN 'missing_identifier' WHEN c_custkey % 13 = 0 THEN 'unusable_name' ELSE 'accepted' END AS outcome, count(*) AS n FROM customer GROUP BY ALL")
def ingest_lei_level1_counts(spark, sf_dir):
    return lei.entities(_level1(spark, sf_dir))[1].select("outcome", "n")


def _level2(spark, sf_dir) -> lists.Reader:
    o, k = cw.spread(cw.table(spark, sf_dir, "orders"), "o_orderkey"), F.col("o_orderkey")
    node = lambda tag, key: _el(tag, _el("rr:NodeID", cw.lei(key)))
    r = _el("rr:Relationship", node("rr:StartNode", F.col("o_custkey")), _if(k % 7 != 0, node("rr:EndNode", k % 100)), _if(k % 11 != 0, _el("rr:RelationshipType", F.col("o_orderstatus"))), _el("rr:RelationshipStatus", "ACTIVE"), _el("rr:RelationshipPeriods", _el("rr:RelationshipPeriod", _el("rr:StartDate", F.date_format("o_orderdate", "yyyy-MM-dd"))), _el("rr:RelationshipPeriod", _el("rr:StartDate", "1900-01-01"))))
    return lists.column(o.select(F.concat(F.lit('<rr:Data xmlns:rr="urn:r">'), _el("rr:RelationshipRecord", r), F.lit("</rr:Data>")).alias("x")), "x")


_LEVEL2 = f"SELECT {cw.sql_lei('o_custkey')} AS child_lei, {cw.sql_lei('o_orderkey % 100')} AS parent_lei, o_orderstatus AS relationship_type, 'ACTIVE' AS relationship_status, strftime(o_orderdate, '%Y-%m-%d') AS relationship_period FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0"


@query(_LEVEL2)
def ingest_lei_level2(spark, sf_dir):
    return lei.relationships(_level2(spark, sf_dir))


@query(f"WITH old AS (SELECT {cw.sql_lei('c_custkey')} AS lei, c_name AS legal_name FROM customer), {LEVEL1_SQL} SELECT lei, legal_name FROM old WHERE lei NOT IN (SELECT lei FROM level1) UNION ALL SELECT lei, legal_name FROM level1")
def upsert_entities(spark, sf_dir):
    """A delta of the registry into what stands."""
    old = conform(cw.table(spark, sf_dir, "customer").select(cw.lei(_c()).alias("lei"), F.col("c_name").alias("legal_name")), LEI_ENTITY)
    return merge.upsert(old, lei.entities(_level1(spark, sf_dir))[0], ["lei"], [F.coalesce("last_update", F.lit(""))]).select("lei", "legal_name")


@query(f"WITH {cw.EDGE_CTE}, batch AS ({_LEVEL2}) SELECT DISTINCT child_lei, parent_lei, relationship_type FROM (SELECT * FROM edge UNION ALL SELECT child_lei, parent_lei, relationship_type FROM batch)")
def insert_relationships(spark, sf_dir):
    """A first load: equal edges are replaced, nothing else goes."""
    old = cw.relationships(spark, sf_dir).dropDuplicates(["child_lei", "parent_lei", "relationship_type"])
    return merge.replace_by_child(conform(old, LEI_RELATIONSHIP), lei.relationships(_level2(spark, sf_dir)), ["relationship_period"], insert_only=True).select("child_lei", "parent_lei", "relationship_type")


# State


def _counted(spark, sf_dir) -> DataFrame:
    """A mirror for each kind of event: those seen more than 2500 times were completed on their last day."""
    e = cw.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("mirror")).agg(F.count("*").alias("total"), F.max("event_id").cast("string").alias("day"))
    done = F.col("total") % 2 == 0
    return conform(e.select("mirror", F.when(done, "complete").otherwise("running").alias("status"), F.when(done, F.col("day")).alias("completed_at"), "total"), MIRROR_STATE)


_COUNTED = "s AS (SELECT event_type AS mirror, count(*) AS total, count(*) % 2 = 0 AS done, max(event_id)::VARCHAR AS day FROM events GROUP BY 1)"


@query(f"WITH {_COUNTED} SELECT mirror, done AS ready, CASE WHEN done THEN 'complete' ELSE 'running' END AS status, CASE WHEN done THEN day END AS completed_at, total FROM s")
def readiness_of_mirrors(spark, sf_dir):
    return merge.readiness(_counted(spark, sf_dir))


@query(f"WITH {_COUNTED} SELECT mirror, CASE WHEN mirror = 'view' THEN 'complete' WHEN done THEN 'complete' ELSE 'running' END AS status, CASE WHEN mirror = 'view' THEN '2030' WHEN done THEN day END AS completed_at, CASE WHEN mirror = 'view' THEN 7 ELSE total END AS total FROM s UNION ALL SELECT 'new', 'complete', '2031', 1")
def mark_ready(spark, sf_dir):
    return merge.marked_ready(merge.marked_ready(_counted(spark, sf_dir), "view", "2030", 7), "new", "2031", 1).select("mirror", "status", "completed_at", "total")


@query(f"WITH {_COUNTED} SELECT mirror, CASE WHEN done THEN '2032' END AS completed_at, CASE WHEN done THEN 99 ELSE total END AS total FROM s")
def advance_if_ready(spark, sf_dir):
    states = _counted(spark, sf_dir)
    for kind in sorted(r.mirror for r in states.select("mirror").collect()):  # a handful of kinds
        states = merge.advanced(states, kind, "2032", 99)
    return states.select("mirror", "completed_at", "total")


# Scalars


@query(f"SELECT p_partkey, {_sql_at(_TYPES, 'p_size')} AS sdn, {_sql_at(('person', 'organization', 'person', 'organization', 'unknown'), 'p_size')} AS eu, {_sql_at(('person', 'organization', 'vessel', 'organization', 'unknown'), 'p_size')} AS uk, {_sql_at(('person', 'organization', 'vessel', 'aircraft', 'unknown'), 'p_size')} AS party FROM part")
def map_entity_types(spark, sf_dir):
    s = F.col("p_size")
    party = normalise.party_type(_at(tuple(a for a, _ in _PARTIES), s), _at(tuple(b for _, b in _PARTIES), s))
    return cw.table(spark, sf_dir, "part").select("p_partkey", normalise.sdn_type(_at(_SDN_TYPES, s)).alias("sdn"), normalise.eu_type(_at(("person", "E", "p", "enterprise", "x"), s)).alias("eu"), normalise.uk_type(_at(("Individual", "Entity", "Ship", "Organisation", "x"), s)).alias("uk"), party.alias("party"))


@query(r"""SELECT page_id, regexp_matches(CASE WHEN page_id % 3 = 0 THEN '  <?xml version="1.0"?><a/>' WHEN page_id % 3 = 1 THEN ' ' || html ELSE '' END, '(?is)^\s*<(!doctype\s+html|html[\s>])') OR page_id % 3 = 2 AS wrong FROM pages""")
def guard_content(spark, sf_dir):
    """What came in place of a feed: a web page, or nothing."""
    body = F.when(F.col("page_id") % 3 == 0, '  <?xml version="1.0"?><a/>').when(F.col("page_id") % 3 == 1, F.concat(F.lit(" "), "html")).otherwise("")
    return cw.table(spark, sf_dir, "pages").select("page_id", feeds.is_wrong(body).alias("wrong"))


@query("SELECT page_id, CASE WHEN page_id % 4 = 0 THEN url || '?full' END AS full_url, CASE WHEN page_id % 4 = 0 THEN url || '?day' WHEN page_id % 4 = 1 THEN url || '?lei2' END AS day_url FROM pages")
def registry_file_urls(spark, sf_dir):
    p = cw.table(spark, sf_dir, "pages")
    url = lambda q: F.struct(F.struct(F.concat("url", F.lit(q)).alias("url")).alias("xml"))
    flat = F.to_json(F.struct(F.array(F.struct(url("?full").alias("full_file"), F.struct(url("?day").alias("LastDay")).alias("delta_files"))).alias("data")))
    deep = F.to_json(F.struct(F.array(F.struct(F.struct(F.struct(url("?lei2").alias("LastDay")).alias("delta_files")).alias("lei2"))).alias("data")))
    index = F.when(F.col("page_id") % 4 == 0, flat).when(F.col("page_id") % 4 == 1, deep).otherwise("{}")
    return p.select("page_id", feeds.file_url(index).alias("full_url"), feeds.file_url(index, window="LastDay").alias("day_url"))


@query(r"SELECT conv_id, turn, nullif(trim(CASE WHEN turn % 2 = 0 THEN '  ' || text || ' ' ELSE '   ' END, ' '), '') AS said FROM conversations")
def as_text(spark, sf_dir):
    said = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("  "), "text", F.lit(" "))).otherwise("   ")
    return cw.table(spark, sf_dir, "conversations").select("conv_id", "turn", blank_to_null(said).alias("said"))


@query("SELECT user_id, count(*) FILTER (event_type <> 'view')::INTEGER AS n FROM events GROUP BY 1 UNION ALL SELECT -1, 0")
def as_array(spark, sf_dir):
    """Lists with holes, and no list at all."""
    e = cw.table(spark, sf_dir, "events").select("user_id", F.when(F.col("event_type") != "view", F.col("event_type")).alias("t"))
    lists_ = e.groupBy("user_id").agg(F.collect_list(F.struct("t")).alias("l")).unionByName(spark.createDataFrame([(-1, None)], "user_id long, l array<struct<t:string>>"))
    return lists_.select("user_id", F.size(feeds.kept(F.col("l"), lambda x: x["t"])).alias("n"))


@query(
    "SELECT source, label, url IS NULL AS unset, licence, (SELECT count(*) FROM part WHERE p_partkey % 5 = i) AS records FROM (VALUES " + ", ".join(f"({i}, '{s['source']}', '{s['label']}', NULL, '{s['licence']}')" for i, s in enumerate(sources_table({})) if s["source"] != "lei") + ") AS t(i, source, label, url, licence)"
)
def source_terms(spark, sf_dir):
    """Each list with its terms, and how many records stand."""
    terms = spark.createDataFrame([(s["source"], s["label"], s["url"], s["licence"]) for s in sources_table({}) if s["source"] in SOURCES], "source string, label string, url string, licence string")
    counts = cw.designations(spark, sf_dir).groupBy("source").agg(F.count("*").alias("records"))
    return terms.join(counts, "source").select("source", "label", F.col("url").isNull().alias("unset"), "licence", "records")
