"""Schemas of the corpus, as DDL."""

ALIASES = "array<struct<name:string,name_type:string>>"
DESIGNATION = f"id string, source string, source_entry_id string, entity_type string, primary_name string, normalized_name string, program string, legal_basis string, designation_date string, aliases {ALIASES}, identifiers array<struct<type:string,value:string,country:string>>, addresses array<struct<full:string,country:string>>, dates_of_birth array<struct<date:string,place:string>>, nationalities array<string>, remarks string"
NAME = "designation_id string, name_ord int, name string, normalized string, tokens array<string>, phonetic string, name_type string"
LEI_ENTITY = "lei string, legal_name string, normalized_name string, other_names array<string>, jurisdiction string, status string, legal_address string, headquarters_address string, registration_authority_id string, registration_authority_entity_id string, last_update string"
LEI_RELATIONSHIP = "child_lei string, parent_lei string, relationship_type string, relationship_status string, relationship_period string"
MIRROR_STATE = "mirror string, status string, completed_at string, total long, checkpoint string"


def empty(ddl: str, column: str):
    """A null or empty value of a column of a schema."""
    from pyspark.sql import functions as F

    kind = next(p.split(" ", 1)[1] for p in _fields(ddl) if p.split(" ", 1)[0] == column)
    return (F.array().cast(kind) if kind.startswith("array") else F.lit(None).cast(kind)).alias(column)


def _fields(ddl: str) -> list[str]:
    out, depth, now = [], 0, ""
    for c in ddl + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(now.strip())
            now = ""
        else:
            now += c
    return out


def conform(df, ddl: str):
    """``df`` with the columns of a schema in its order; those it lacks are null, lists empty."""
    from pyspark.sql import functions as F

    cols = []
    for f in _fields(ddl):
        name, kind = f.split(" ", 1)
        if name in df.columns:
            c = F.col(name).cast(kind)
            cols.append((F.coalesce(c, F.array().cast(kind)) if kind.startswith("array") else c).alias(name))
        else:
            cols.append(empty(ddl, name))
    return df.select(*cols)
