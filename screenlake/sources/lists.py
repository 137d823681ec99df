"""The five watch-lists in one schema. Each normaliser takes rows of its feed's elements, from files or from a column."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from screenlake.functions.normalise import births, composed_date, eu_type, joined_address, party_type, remark_date, sdn_type, uk_type
from screenlake.operators.merge import last_known
from screenlake.sources.feeds import designations, kept, parse_records, read_records, spaced, text

Reader = Callable[[str, str], DataFrame]

SDN = "uid string, firstName string, lastName string, sdnType string, programList struct<program:array<string>>, program string, remarks string, akaList struct<aka:array<struct<category:string,firstName:string,lastName:string>>>, idList struct<id:array<struct<idType:string,idNumber:string,idCountry:string>>>, addressList struct<address:array<struct<address1:string,address2:string,city:string,stateOrProvince:string,postalCode:string,country:string>>>, dateOfBirthList struct<dateOfBirthItem:array<struct<dateOfBirth:string>>>, nationalityList struct<nationality:array<struct<country:string>>>"
_DAY = "struct<Year:string,Month:string,Day:string>"
PARTY = f"_FixedRef string, _ID string, Profile struct<_PartySubTypeID:string,Identity:array<struct<Alias:array<struct<_AliasTypeID:string,_Primary:string,_LowQuality:string,DocumentedName:array<struct<DocumentedNamePart:array<struct<NamePartValue:string>>>>>>>>,Feature:array<struct<_FeatureTypeID:string,FeatureVersion:struct<VersionDetail:string,VersionLocation:string,DatePeriod:struct<Start:struct<`From`:{_DAY}>>>>>>"
_LABEL = "array<struct<_ID:string,_VALUE:string>>"
REFERENCE = f"AliasTypeValues struct<AliasType:{_LABEL}>, FeatureTypeValues struct<FeatureType:{_LABEL}>, PartySubTypeValues struct<PartySubType:array<struct<_ID:string,_PartyTypeID:string,_VALUE:string>>>"
ENTRY = f"_ID string, _ProfileID string, EntryEvent struct<Date:{_DAY}>, SanctionsMeasure array<struct<Comment:string>>"
EU = "_logicalId string, _euReferenceNumber string, regulation array<struct<_programme:string,_publicationDate:string>>, subjectType struct<_code:string>, nameAlias array<struct<_wholeName:string,_firstName:string,_lastName:string,_strong:string>>, birthdate array<struct<_birthdate:string>>, citizenship array<struct<_countryDescription:string>>"
UK = "_UniqueID string, UniqueID string, OFSIGroupID string, DateDesignated string, LastUpdated string, RegimeName string, IndividualEntityShip string, GroupType string, Name string, Names struct<Name:array<struct<Name1:string,Name2:string,Name3:string,Name4:string,Name5:string,Name6:string,NameType:string,WholeName:string>>,WholeName:string>, Nationalities struct<Nationality:array<string>>, OtherInformation string"
UN = "DATAID string, REFERENCE_NUMBER string, FIRST_NAME string, SECOND_NAME string, THIRD_NAME string, FOURTH_NAME string, UN_LIST_TYPE string, LISTED_ON string, {kind}_ALIAS array<struct<QUALITY:string,ALIAS_NAME:string>>, INDIVIDUAL_DATE_OF_BIRTH array<struct<DATE:string,YEAR:string>>, INDIVIDUAL_DOCUMENT array<struct<TYPE_OF_DOCUMENT:string,NUMBER:string,ISSUING_COUNTRY:string>>, NATIONALITY struct<VALUE:array<string>>, COMMENTS1 string"


def files(spark: SparkSession, paths: str | Sequence[str]) -> Reader:
    return lambda tag, schema: read_records(spark, paths, tag, schema)


def column(texts: DataFrame, name: str) -> Reader:
    return lambda tag, schema: parse_records(texts, name, (tag,), schema)


def _named(name: Column, kind: Column | str) -> Column:
    return F.struct(name.alias("name"), (F.lit(kind) if isinstance(kind, str) else kind).alias("name_type"))


def _dates(values: Column) -> Column:
    return F.transform(values, lambda d: F.struct(d.alias("date"), F.lit(None).cast("string").alias("place")))


def ofac_standard(read: Reader, source: str = "ofac_sdn") -> tuple[DataFrame, DataFrame]:
    r = read("sdnEntry", SDN)
    aka = kept(F.col("akaList.aka"), lambda a: _named(spaced(a["firstName"], a["lastName"]), F.when(F.lower(F.trim(a["category"])) == "weak", "low-quality-aka").otherwise("aka")))
    ids = F.filter(kept(F.col("idList.id"), lambda i: F.struct(F.coalesce(text(i["idType"]), F.lit("ID")).alias("type"), text(i["idNumber"]).alias("value"), text(i["idCountry"]).alias("country"))), lambda i: i["value"].isNotNull())
    where = F.filter(kept(F.col("addressList.address"), lambda a: F.struct(joined_address(a["address1"], a["address2"], a["city"], a["stateOrProvince"], a["postalCode"], a["country"]).alias("full"), text(a["country"]).alias("country"))), lambda a: a["full"].isNotNull())
    rows = r.select(
        text(F.col("uid")).alias("entry"), sdn_type(F.col("sdnType")).alias("entity_type"), F.coalesce(text(F.col("program")), F.get("programList.program", F.lit(0))).alias("program"), remark_date(F.col("remarks")).alias("designation_date"), text(F.col("remarks")).alias("remarks"),
        F.concat(F.array(_named(spaced(F.col("firstName"), F.col("lastName")), "primary")), aka).alias("raw_named"), ids.alias("identifiers"), where.alias("addresses"),
        _dates(kept(F.col("dateOfBirthList.dateOfBirthItem"), lambda d: text(d["dateOfBirth"]))).alias("dates_of_birth"), kept(F.col("nationalityList.nationality"), lambda n: text(n["country"])).alias("nationalities"),
    )
    # An unusable primary name isn't made up for by an alias.
    first = F.get("raw_named", F.lit(0))
    rows = rows.withColumn("named", F.when(first["name"].isNull() | first["name"].contains("�"), F.array().cast("array<struct<name:string,name_type:string>>")).otherwise(F.col("raw_named")))
    return designations(rows.drop("raw_named"), source)


def ofac_references(read: Reader) -> dict[str, DataFrame]:
    """``alias``, ``feature`` (id, label) and ``subtype`` (id, party, label): a few hundred rows."""
    r = read("ReferenceValueSets", REFERENCE)
    return {
        "alias": r.select(F.explode("AliasTypeValues.AliasType").alias("t")).select(F.col("t._ID").alias("id"), F.col("t._VALUE").alias("label")),
        "feature": r.select(F.explode("FeatureTypeValues.FeatureType").alias("t")).select(F.col("t._ID").alias("id"), F.col("t._VALUE").alias("label")),
        "subtype": r.select(F.explode("PartySubTypeValues.PartySubType").alias("t")).select(F.col("t._ID").alias("id"), F.col("t._PartyTypeID").alias("party"), F.col("t._VALUE").alias("label")),
    }


def ofac_deferred(read: Reader, source: str) -> DataFrame:
    """(source, source_entry_id, program, designation_date): of each field the last entry that publishes it."""
    e = read("SanctionsEntry", ENTRY)
    said = kept(F.col("SanctionsMeasure"), lambda m: text(m["Comment"]))
    day = F.col("EntryEvent.Date")
    rows = e.select(text(F.col("_ProfileID")).alias("source_entry_id"), F.when(F.size(said) > 0, F.array_join(said, ", ")).alias("program"), composed_date(day["Year"], day["Month"], day["Day"]).alias("designation_date"), F.struct(F.expr("try_cast(_ID AS bigint)"), "_ID").alias("turn"))
    got = last_known(rows.where("source_entry_id IS NOT NULL"), "source_entry_id", F.col("turn"), ["program", "designation_date"])
    return got.withColumn("source", F.lit(source))


def ofac_advanced(read: Reader, source: str = "ofac_sdn") -> tuple[DataFrame, DataFrame]:
    """Without programmes and dates: these come last in the feed, by ``ofac_deferred``."""
    refs = ofac_references(read)
    lookup = lambda name, value: refs[name].agg(F.map_from_entries(F.collect_list(F.struct("id", value))).alias(name))
    sub = refs["subtype"].withColumn("both", F.struct("party", "label"))
    r = read("DistinctParty", PARTY)
    for small in (lookup("alias", "label"), lookup("feature", "label"), sub.agg(F.map_from_entries(F.collect_list(F.struct("id", "both"))).alias("subtype"))):
        r = r.crossJoin(F.broadcast(small))  # one row, of a few hundred labels
    label = lambda a: F.upper(F.replace(F.coalesce(F.col("alias")[a["_AliasTypeID"]], F.lit("")), F.lit("."), F.lit("")))
    kind = lambda a: F.when(a["_Primary"] == "true", "primary").when(a["_LowQuality"] == "true", "low-quality-aka").when(label(a) == "FKA", "fka").otherwise("aka")
    name = lambda d: text(F.array_join(kept(d["DocumentedNamePart"], lambda p: text(p["NamePartValue"])), " "))
    of_alias = lambda a: F.coalesce(F.transform(a["DocumentedName"], lambda d: _named(name(d), kind(a))), F.array().cast("array<struct<name:string,name_type:string>>"))
    listed = F.flatten(F.flatten(F.transform(F.col("Profile.Identity"), lambda i: F.transform(i["Alias"], of_alias))))
    r = r.withColumn("listed", F.filter(F.coalesce(listed, F.array().cast("array<struct<name:string,name_type:string>>")), lambda n: n["name"].isNotNull() & ~n["name"].contains("�")))
    # The first that is flagged as primary leads, else the first.
    at = F.coalesce(F.nullif(F.array_position(F.transform("listed", lambda n: n["name_type"]), "primary"), F.lit(0)), F.lit(1)).cast("int")
    r = r.withColumn("named", F.when(F.size("listed") > 0, F.concat(F.slice("listed", at, 1), F.slice("listed", F.lit(1), at - 1), F.slice("listed", at + 1, F.size("listed")))).otherwise(F.col("listed")))
    of = lambda f, which: F.lower(F.col("feature")[f["_FeatureTypeID"]]) == which
    start = lambda f: f["FeatureVersion"]["DatePeriod"]["Start"]["From"]
    dates = kept(F.filter("Profile.Feature", lambda f: of(f, "birthdate")), lambda f: composed_date(start(f)["Year"], start(f)["Month"], start(f)["Day"]))
    places = kept(F.filter("Profile.Feature", lambda f: of(f, "place of birth")), lambda f: F.coalesce(text(f["FeatureVersion"]["VersionDetail"]), text(f["FeatureVersion"]["VersionLocation"])))
    kind_of = F.col("subtype")[F.col("Profile._PartySubTypeID")]
    rows = r.select(F.coalesce(text(F.col("_FixedRef")), text(F.col("_ID"))).alias("entry"), party_type(kind_of["party"], F.coalesce(kind_of["label"], F.lit(""))).alias("entity_type"), "named", births(dates, places).alias("dates_of_birth"))
    return designations(rows, source)


def eu(read: Reader) -> tuple[DataFrame, DataFrame]:
    """Programme and date are those of the only regulation; of several, none."""
    r = read("sanctionEntity", EU)
    name = lambda n: F.coalesce(text(n["_wholeName"]), spaced(n["_firstName"], n["_lastName"]))
    only = F.when(F.size("regulation") == 1, F.get("regulation", F.lit(0)))
    rows = r.select(
        F.coalesce(text(F.col("_logicalId")), text(F.col("_euReferenceNumber"))).alias("entry"), eu_type(F.col("subjectType._code")).alias("entity_type"), kept(F.col("nameAlias"), lambda n: _named(name(n), F.when(n["_strong"] == "false", "low-quality-aka").otherwise("aka"))).alias("named"),
        text(only["_programme"]).alias("program"), text(only["_publicationDate"]).alias("designation_date"), _dates(kept(F.col("birthdate"), lambda b: text(b["_birthdate"]))).alias("dates_of_birth"), kept(F.col("citizenship"), lambda c: text(c["_countryDescription"])).alias("nationalities"),
    )
    return designations(rows, "eu")


def uk(read: Reader) -> tuple[DataFrame, DataFrame]:
    r = read("Designation", UK)
    parts = lambda n: spaced(*(n[f"Name{i}"] for i in range(1, 7)))
    whole = lambda n: F.when(text(n["NameType"]).isNotNull() & parts(n).isNotNull(), parts(n)).otherwise(F.coalesce(text(n["WholeName"]), parts(n)))
    listed = F.filter(kept(F.col("Names.Name"), lambda n: _named(whole(n), "aka")), lambda n: n["name"].isNotNull() & ~n["name"].contains("�"))
    spare = F.array(_named(F.coalesce(text(F.col("Name")), text(F.col("Names.WholeName"))), "aka"))
    rows = r.select(
        F.coalesce(text(F.col("UniqueID")), text(F.col("OFSIGroupID")), text(F.col("_UniqueID"))).alias("entry"), uk_type(F.coalesce("IndividualEntityShip", "GroupType")).alias("entity_type"), F.when(F.size(listed) > 0, listed).otherwise(spare).alias("named"),
        text(F.col("RegimeName")).alias("program"), text(F.coalesce("DateDesignated", "LastUpdated")).alias("designation_date"), kept(F.col("Nationalities.Nationality"), text).alias("nationalities"), text(F.col("OtherInformation")).alias("remarks"),
    )
    return designations(rows, "uk")


def _un(read: Reader, tag: str, kind: str) -> DataFrame:
    r = read(tag, UN.format(kind=tag))
    every = spaced(*(F.col(f"{n}_NAME") for n in ("FIRST", "SECOND", "THIRD", "FOURTH")))
    primary = every if kind == "person" else F.coalesce(text(F.col("FIRST_NAME")), every)
    aliases = kept(F.col(f"{tag}_ALIAS"), lambda a: _named(text(a["ALIAS_NAME"]), F.when(F.lower(F.trim(a["QUALITY"])) == "low", "low-quality-aka").otherwise("aka")))
    none = F.array().cast("array<struct<name:string,name_type:string>>")
    papers = F.filter(kept(F.col("INDIVIDUAL_DOCUMENT"), lambda d: F.struct(F.coalesce(text(d["TYPE_OF_DOCUMENT"]), F.lit("Document")).alias("type"), text(d["NUMBER"]).alias("value"), text(d["ISSUING_COUNTRY"]).alias("country"))), lambda i: i["value"].isNotNull())
    return r.select(
        F.coalesce(text(F.col("DATAID")), text(F.col("REFERENCE_NUMBER"))).alias("entry"), F.lit(kind).alias("entity_type"), F.when(primary.isNull() | primary.contains("�"), none).otherwise(F.concat(F.array(_named(primary, "primary")), aliases)).alias("named"),
        text(F.col("UN_LIST_TYPE")).alias("program"), text(F.col("LISTED_ON")).alias("designation_date"), papers.alias("identifiers"), _dates(kept(F.col("INDIVIDUAL_DATE_OF_BIRTH"), lambda d: F.coalesce(text(d["DATE"]), text(d["YEAR"])))).alias("dates_of_birth"), kept(F.col("NATIONALITY.VALUE"), text).alias("nationalities"), text(F.col("COMMENTS1")).alias("remarks"),
    )


def un(read: Reader) -> tuple[DataFrame, DataFrame]:
    return designations(_un(read, "INDIVIDUAL", "person").unionByName(_un(read, "ENTITY", "organization")), "un")


@dataclass(frozen=True)
class Source:
    """One list: how its feed becomes designations and counts, and whether programmes come at its end."""

    code: str
    normalise: Callable[[Reader], tuple[DataFrame, DataFrame]]
    deferred: Callable[[Reader], DataFrame] | None = None


def ofac(read: Reader, source: str) -> tuple[DataFrame, DataFrame]:
    """Either form of the feed, told by its records: the advanced one has parties, the standard one entries. What there is none of is empty."""
    new, old = ofac_advanced(read, source), ofac_standard(read, source)
    return new[0].unionByName(old[0]), new[1].unionByName(old[1]).groupBy("source", "outcome").agg(F.sum("n").alias("n")).select("outcome", "n", "source")


REGISTRY = [
    Source("ofac_sdn", lambda read: ofac(read, "ofac_sdn"), lambda read: ofac_deferred(read, "ofac_sdn")),
    Source("ofac_consolidated", lambda read: ofac(read, "ofac_consolidated"), lambda read: ofac_deferred(read, "ofac_consolidated")),
    Source("eu", eu),
    Source("uk", uk),
    Source("un", un),
]


def harvest(readers: dict[str, Reader], turn: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(designations of all sources that have a reader, counts by source and outcome), late programmes joined. ``turn``: a column of the order in the feed."""
    from screenlake.operators.merge import apply_deferred

    rows, counts = [], []
    for s in REGISTRY:
        if s.code in readers:
            d, n = s.normalise(readers[s.code])
            if turn:
                d = d.withColumn(turn, F.monotonically_increasing_id())
            rows.append(apply_deferred(d, s.deferred(readers[s.code])) if s.deferred else d)
            counts.append(n)
    return reduce(DataFrame.unionByName, rows), reduce(DataFrame.unionByName, counts)
