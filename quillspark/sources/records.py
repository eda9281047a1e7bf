"""Raw records of a collection or works API to corpus rows, by expressions on parsed JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillspark.functions import text as T

#: What is read of a raw record; other fields are dropped on arrival.
RECORD = (
    "code string, collection string, doi string, kind string, year string, language string, "
    "titles array<struct<language:string,text:string>>, abstracts array<struct<language:string,text:string>>, keywords array<struct<language:string,text:string>>, "
    "authors array<struct<given:string,surname:string,orcid:string,affiliations:array<string>>>, "
    "references array<struct<title:string,source:string,year:string,authors:array<struct<given:string,surname:string>>>>"
)
WORK = (
    "id string, doi string, year int, language string, citations int, abstract_index map<string,array<int>>, "
    "locations array<struct<source:string,issn:array<string>,licence:string,url:string>>, "
    "authorships array<struct<name:string,orcid:string,institutions:array<struct<id:string,name:string,country:string>>>>, references array<string>"
)


def _tidy(texts: Column, origin: str) -> Column:
    """One cleaned text for each language, the first there is; empty ones go."""
    given = F.coalesce(texts, F.array().cast("array<struct<language:string,text:string>>"))
    clean = F.filter(F.transform(given, lambda t: F.struct(t["language"].alias("language"), T.clean_markup(t["text"]).alias("text"), F.lit(origin).alias("origin"))), lambda t: F.length(t["text"]) > 0)
    return F.aggregate(clean, F.slice(clean, 1, 0), lambda seen, t: F.when(F.exists(seen, lambda s: s["language"].eqNullSafe(t["language"])), seen).otherwise(F.concat(seen, F.array(t))))


def documents(raw: DataFrame, column: str, source: str) -> DataFrame:
    """Corpus rows of JSON records: whitelisted fields, one text a language, distinct keywords, valid orcids."""
    r = raw.select(F.from_json(column, RECORD).alias("r")).where("r.code IS NOT NULL").select("r.*")
    words = F.transform(F.col("keywords"), lambda k: F.struct(k["language"].alias("language"), T.clean_markup(k["text"]).alias("text"), F.lit(source).alias("origin")))
    people = F.transform(F.col("authors"), lambda a: F.struct(T.clean_markup(a["given"]).alias("given"), T.clean_markup(a["surname"]).alias("surname"), F.when(T.orcid_is_valid(T.orcid(a["orcid"])), T.orcid(a["orcid"])).alias("orcid"), F.array_distinct(a["affiliations"]).alias("affiliations")))
    return r.select(
        F.col("code").alias("id"),
        F.col("code").alias("pid"),
        "collection",
        T.doi(F.col("doi")).alias("doi"),
        F.lit(source).alias("source"),
        F.array(F.lit(source)).alias("origins"),
        "kind",
        F.coalesce(F.col("year").try_cast("int"), T.year_of_pid(F.col("code"))).alias("year"),
        F.col("language").alias("original_language"),
        _tidy(F.col("titles"), source).alias("titles"),
        _tidy(F.col("abstracts"), source).alias("abstracts"),
        F.array_distinct(words).alias("keywords"),
        people.alias("authors"),
    )


def references(raw: DataFrame, column: str, most_authors: int = 3) -> DataFrame:
    """(doc, position, title, source, surnames, given, year): a row for each reference, its first authors in order."""
    r = raw.select(F.from_json(column, RECORD).alias("r")).select(F.col("r.code").alias("doc"), F.posexplode("r.references").alias("at", "x"))
    few = F.slice("x.authors", 1, most_authors)
    return r.select("doc", (F.col("at") + 1).alias("position"), F.col("x.title").alias("title"), F.col("x.source").alias("source"), F.transform(few, lambda a: a["surname"]).alias("surnames"), F.transform(few, lambda a: a["given"]).alias("given"), F.col("x.year").try_cast("int").alias("year"))


def works(raw: DataFrame, column: str) -> DataFrame:
    """Works of JSON records: abstract put together from its index, the location with an ISSN, its licence."""
    w = raw.select(F.from_json(column, WORK).alias("w")).where("w.id IS NOT NULL").select("w.*")
    place = F.coalesce(F.try_element_at(F.filter("locations", lambda x: F.size(x["issn"]) > 0), F.lit(1)), F.try_element_at("locations", F.lit(1)))
    return w.select("id", T.doi(F.col("doi")).alias("doi"), "year", "language", "citations", F.when(F.size("abstract_index") > 0, T.inverted_abstract(F.col("abstract_index"))).alias("abstract"), place["source"].alias("journal"), T.licence(place["licence"]).alias("licence"), T.safe_url(place["url"]).alias("url"), "authorships", "references")


def enrich(docs: DataFrame, matches: DataFrame, found: DataFrame) -> DataFrame:
    """Documents with what their matched work adds: only nulls are filled, the licence is the more restrictive one."""
    w = found.select(F.col("id").alias("_work"), F.col("doi").alias("_doi"), F.col("citations").alias("_citations"), F.col("licence").alias("_licence"), F.col("url").alias("_url"))
    j = docs.join(matches.select(F.col("doc").alias("id"), F.col("work").alias("_work"), F.col("step").alias("_step")), "id", "left").join(w, "_work", "left")
    fill = {"work": "_work", "doi": "_doi", "citations": "_citations", "url": "_url", "match": "_step"}
    own = {c: F.coalesce(c, F.col(n).cast(docs.schema[c].dataType)) for c, n in fill.items() if c in docs.columns}
    return j.withColumns(own | {"licence": T.more_restrictive(F.col("licence"), F.col("_licence"))}).select(*docs.columns)


def corrected_languages(texts: DataFrame, key: str, text: str, declared: str) -> DataFrame:
    """Texts whose declared language is replaced where the function words clearly speak for another."""
    hits = T.language_hits(texts.select(F.xxhash64(key, text, declared).alias("_k"), text).dropDuplicates(["_k"]), "_k", text).select("_k", "detected")
    return texts.withColumn("_k", F.xxhash64(key, text, declared)).join(hits, "_k", "left").withColumn(declared, F.coalesce("detected", declared)).drop("_k", "detected")
