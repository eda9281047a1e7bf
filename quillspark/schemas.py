"""Explicit schemas of the corpus and of the stages' tables."""

from __future__ import annotations

from pyspark.sql.types import StructType

TEXT = "struct<language:string,text:string,origin:string>"
AUTHOR = "struct<given:string,surname:string,orcid:string,affiliations:array<string>>"
AFFILIATION = "struct<id:string,institution:string,divisions:array<string>,city:string,state:string,country:string,source:string,city_import:string,state_import:string>"
INSTITUTION = "struct<id:string,ror:string,name:string,country:string,kind:string,lineage:array<string>>"
AUTHORSHIP = f"struct<name:string,institutions:array<{INSTITUTION}>,countries:array<string>,affiliations:array<struct<text:string,institutions:array<string>>>,id:string,orcid:string>"

#: The corpus row; readers never infer it.
DOCUMENT = (
    "id string, pid string, collection string, doi string, work string, source string, origins array<string>, kind string, year int, "
    "original_language string, journal_issn string, journal_acronym string, journal_title string, "
    f"titles array<{TEXT}>, abstracts array<{TEXT}>, keywords array<{TEXT}>, authors array<{AUTHOR}>, affiliations array<{AFFILIATION}>, "
    f"affiliations_source string, authorships array<{AUTHORSHIP}>, url string, citations int, n_references int, licence string, "
    "licence_source string, licence_work string, licence_journal string, match string, possible_duplicate_of string"
)
ASSIGNMENTS = "id string, topic int, assignment string, x float, y float, neighbours array<int>, analysis_language string, analysis_source string"
LINKS = "doc string, author int, institution string, city string, state string, country string, level string"
WEIGHTS = "doc string, institution string, state string, country string, weight double"
CLASSIFICATIONS = "doc string, variable string, value string, evidence string, status string, field string, start int, end int, attempts int, valid_at_first boolean, seconds double"
IMPORTED = "pid string, collection string, doi string, title string, year int, origin string"
REFERENCES = "doc string, position int, title string, source string, surnames array<string>, given array<string>, year int"


def struct(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


def json_schemas(tables: dict[str, str]) -> dict[str, str]:
    """Name to JSON schema of each table."""
    return {name: struct(ddl).json() for name, ddl in tables.items()}
