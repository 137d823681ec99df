"""Legal-entity records (Level 1) and who owns whom (Level 2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenlake.functions.normalise import joined_address
from screenlake.functions.text import fold, usable
from screenlake.operators.merge import tallied
from screenlake.schemas import LEI_ENTITY, LEI_RELATIONSHIP, conform
from screenlake.sources.feeds import kept, text
from screenlake.sources.lists import Reader

_ADDRESS = "struct<FirstAddressLine:string,AdditionalAddressLine:array<string>,City:string,Region:string,PostalCode:string,Country:string>"
_NAME = "struct<_VALUE:string>"
LEVEL1 = f"LEI string, Entity struct<LegalName:{_NAME},OtherEntityNames:struct<OtherEntityName:array<{_NAME}>>,LegalJurisdiction:string,LegalAddress:{_ADDRESS},HeadquartersAddress:{_ADDRESS},RegistrationAuthority:struct<RegistrationAuthorityID:string,RegistrationAuthorityEntityID:string>,EntityStatus:string>, Registration struct<RegistrationStatus:string,LastUpdateDate:string>"
LEVEL2 = "Relationship struct<StartNode:struct<NodeID:string>,EndNode:struct<NodeID:string>,RelationshipType:string,RelationshipStatus:string,RelationshipPeriods:struct<RelationshipPeriod:array<struct<StartDate:string>>>>"


def _address(a: Column) -> Column:
    return joined_address(a["FirstAddressLine"], F.array_join(a["AdditionalAddressLine"], ", "), a["City"], a["Region"], a["PostalCode"], a["Country"])


def entities(read: Reader) -> tuple[DataFrame, DataFrame]:
    """(entities, counts by outcome). The status is the registration's, else the entity's."""
    r = read("LEIRecord", LEVEL1)
    e, g = F.col("Entity"), F.col("Registration")
    rows = r.select(
        text(F.col("LEI")).alias("lei"), text(e["LegalName"]["_VALUE"]).alias("legal_name"), F.filter(kept(e["OtherEntityNames"]["OtherEntityName"], lambda n: text(n["_VALUE"])), usable).alias("other_names"), text(e["LegalJurisdiction"]).alias("jurisdiction"),
        F.coalesce(text(g["RegistrationStatus"]), text(e["EntityStatus"])).alias("status"), _address(e["LegalAddress"]).alias("legal_address"), _address(e["HeadquartersAddress"]).alias("headquarters_address"),
        text(e["RegistrationAuthority"]["RegistrationAuthorityID"]).alias("registration_authority_id"), text(e["RegistrationAuthority"]["RegistrationAuthorityEntityID"]).alias("registration_authority_entity_id"), text(g["LastUpdateDate"]).alias("last_update"),
    )
    fine, counts = tallied(rows, F.col("lei"), usable(F.col("legal_name")))
    return conform(fine.withColumn("normalized_name", fold(F.col("legal_name"))), LEI_ENTITY), counts


def relationships(read: Reader) -> DataFrame:
    """Edges with both ends and a type; others are left out. The period is the start of the first."""
    r = F.col("Relationship")
    rows = read("RelationshipRecord", LEVEL2).select(text(r["StartNode"]["NodeID"]).alias("child_lei"), text(r["EndNode"]["NodeID"]).alias("parent_lei"), text(r["RelationshipType"]).alias("relationship_type"), text(r["RelationshipStatus"]).alias("relationship_status"), text(F.get(r["RelationshipPeriods"]["RelationshipPeriod"], F.lit(0))["StartDate"]).alias("relationship_period"))
    return conform(rows.where("child_lei IS NOT NULL AND parent_lei IS NOT NULL AND relationship_type IS NOT NULL"), LEI_RELATIONSHIP)
