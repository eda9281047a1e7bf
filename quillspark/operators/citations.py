"""Citations: internal and external references, flows, canon, same works and corrections by majority."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .graph import component_labels

GENERIC_TITLES = ["introduction", "editorial", "preface", "foreword", "conclusion", "untitled"]


def split_references(references: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc, cited, cited_doc, kind): internal, external, self or anachronic (cited more than a year later).

    ``references`` has (doc, cited), ``docs`` (doc, work, year); repeated references count once.
    """
    own = references.select("doc", "cited").distinct()
    citing = docs.select("doc", F.col("year").alias("_year"))
    cited = docs.where("work IS NOT NULL").select(F.col("work").alias("cited"), F.col("doc").alias("cited_doc"), F.col("year").alias("_cited_year"))
    j = own.join(citing, "doc").join(cited, "cited", "left")
    kind = F.when(F.col("cited_doc").isNull(), "external").when(F.col("cited_doc") == F.col("doc"), "self").when(F.col("_cited_year") > F.col("_year") + 1, "anachronic").otherwise("internal")
    return j.select("doc", "cited", "cited_doc", kind.alias("kind"))


def flow(citations: DataFrame, groups: DataFrame, doc: str = "doc", cited: str = "cited_doc") -> DataFrame:
    """(source, target, n): citations between groups (key, group)."""
    g = groups.select("key", "group")
    return (
        citations.join(g.select(F.col("key").alias(doc), F.col("group").alias("source")), doc)
        .join(g.select(F.col("key").alias(cited), F.col("group").alias("target")), cited)
        .groupBy("source", "target")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def canon(citations: DataFrame, works: DataFrame, k: int = 200) -> DataFrame:
    """(work, citers, rank): external works by distinct citing documents, records of one work together, generic titles out.

    ``works`` has (record, work, title, citations): ``work`` groups records. The
    record with most citers stands for the work; then most citations, then id.
    """
    per_record = citations.select("doc", F.col("cited").alias("record")).distinct().join(works, "record")
    usable = per_record.where(~F.lower(F.trim("title")).isin(*GENERIC_TITLES))
    citers = usable.groupBy("work").agg(F.countDistinct("doc").alias("citers"))
    main = usable.groupBy("work", "record").agg(F.count(F.lit(1)).alias("n"), F.max("citations").alias("c")).groupBy("work").agg(F.min_by("record", F.struct((-F.col("n")).alias("n"), (-F.coalesce("c", F.lit(0))).alias("c"), "record")).alias("record"))
    top = citers.join(main, "work").orderBy(F.desc("citers"), "record").limit(k)
    return top.select(F.col("record").alias("work"), "citers", F.row_number().over(Window.orderBy(F.desc("citers"), "record")).alias("rank"))


def same_titles(a: Column, b: Column, least: int = 15) -> Column:
    """Whether two normalised titles are equal, or one long enough begins the other."""
    return (a == b) | ((F.least(F.length(a), F.length(b)) >= least) & (a.startswith(b) | b.startswith(a)))


def title_matches(left: DataFrame, right: DataFrame, title: str, key: str, least: int = 15) -> DataFrame:
    """(left, right): titles that are equal or begin each other; an equality join on their first characters."""
    a = left.select(F.col(key).alias("left"), F.col(title).alias("_a"), F.substring(title, 1, least).alias("_p"))
    b = right.select(F.col(key).alias("right"), F.col(title).alias("_b"), F.substring(title, 1, least).alias("_p"))
    return a.join(b, "_p").where(same_titles(F.col("_a"), F.col("_b"), least)).select("left", "right")


def same_works(records: DataFrame, ratio: float = 0.92, prefix: int = 20, long_enough: int = 25) -> DataFrame:
    """(record, work): records (record, surname, title) of the same first surname whose titles are equal, begin each other, or are very similar.

    Records meet in blocks of a surname and a shared word of the title, after
    equal titles have become one; components are taken over the links.
    """
    own = records.select("record", "surname", "title").where("title IS NOT NULL AND surname IS NOT NULL")
    titles = own.groupBy("surname", "title").agg(F.min("record").alias("first"))
    words = titles.select("surname", "title", "first", F.explode(F.array_distinct(F.split("title", " "))).alias("w")).where(F.length("w") > 3)
    rare = words.groupBy("surname", "w").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = words.join(rare.drop("n"), ["surname", "w"])
    x, y = met.alias("x"), met.alias("y")
    pairs = x.join(y, (F.col("x.surname") == F.col("y.surname")) & (F.col("x.w") == F.col("y.w")) & (F.col("x.first") < F.col("y.first"))).select(F.col("x.first").alias("a"), F.col("y.first").alias("b"), F.col("x.title").alias("ta"), F.col("y.title").alias("tb")).distinct()

    @F.pandas_udf("double")
    def block_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        return pd.Series([SequenceMatcher(None, p, q, autojunk=False).ratio() if 2 * min(len(p), len(q)) >= ratio * (len(p) + len(q)) else 0.0 for p, q in zip(a, b, strict=True)], dtype="float64")

    near = same_titles(F.col("ta"), F.col("tb"), prefix) | ((F.least(F.length("ta"), F.length("tb")) >= long_enough) & (block_ratio("ta", "tb") >= ratio))
    labels = component_labels(pairs.where(near).select("a", "b"))
    named = titles.join(labels, F.col("first") == F.col("node"), "left").select("surname", "title", F.coalesce("component", "first").alias("work"))
    return own.join(named, ["surname", "title"]).select("record", "work")


def majority_surnames(references: DataFrame, work: str, doc: str, surnames: str, least: int = 3, share: float = 0.2, co: float = 0.5) -> DataFrame:
    """(work, surname, part): surnames that at least ``co`` of a work's citing references give, if enough of them give any.

    Evidence is enough at ``least`` references and ``share`` of the citers.
    """
    citers = references.groupBy(work).agg(F.countDistinct(doc).alias("citers"), F.countDistinct(F.when(F.size(surnames) > 0, F.col(doc))).alias("n"))
    enough = citers.where(F.col("n") >= F.greatest(F.lit(float(least)), F.lit(share) * F.col("citers")))
    given = references.select(work, doc, F.explode(F.array_distinct(surnames)).alias("surname")).groupBy(work, "surname").agg(F.countDistinct(doc).alias("k"))
    return given.join(enough, work).select(work, "surname", (F.col("k") / F.col("n")).alias("part")).where(F.col("part") >= co)


def majority_year(references: DataFrame, work: str, year: str) -> DataFrame:
    """(work, year): the year half of the references give, else the most common one with 30 %, else the earliest given twice."""
    counts = references.where(F.col(year).isNotNull()).groupBy(work, year).agg(F.count(F.lit(1)).alias("k"))
    per = counts.groupBy(work).agg(F.sum("k").alias("n"), F.min(F.struct((-F.col("k")).alias("k"), F.col(year).alias("y"))).alias("top"), F.min(F.when(F.col("k") > 1, F.col(year))).alias("twice"))
    return per.select(work, F.when(-F.col("top.k") >= 0.3 * F.col("n"), F.col("top.y")).otherwise(F.col("twice")).alias(year))


def coverage(docs: DataFrame, references: DataFrame) -> DataFrame:
    """(doc, n_references): -1 for documents that were not matched to a work, 0 for those matched without references."""
    n = references.select("doc", "cited").distinct().groupBy("doc").agg(F.count(F.lit(1)).alias("n"))
    return docs.join(n, "doc", "left").select("doc", F.when(F.col("work").isNull(), -1).otherwise(F.coalesce("n", F.lit(0))).alias("n_references"))
