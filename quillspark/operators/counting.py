"""Fractional and whole counting of affiliations, and the places they count for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

UNIDENTIFIED = "unidentified"


def fractional(documents: DataFrame, links: DataFrame, places: list[str]) -> DataFrame:
    """(doc, *places, weight): one for each document, shared by authors and then by their links.

    ``documents`` has (doc, n_authors); ``links`` has (doc, author, *places), a
    null author for a link no author claims (an orphan). An author without links
    takes the orphans of the document; if every author has links, orphans are
    shared with everyone's own. What is left over counts for no place, so the
    weights of a document add up to 1. Authors are numbered from 0.
    """
    own = links.where("author IS NOT NULL")
    orphans = links.where("author IS NULL")
    spine = documents.select("doc", "n_authors", F.explode_outer(F.when(F.col("n_authors") > 0, F.sequence(F.lit(0), F.col("n_authors") - 1))).alias("author"))
    has = own.select("doc", "author").distinct().withColumn("has", F.lit(True))
    spine = spine.join(has, ["doc", "author"], "left").withColumn("has", F.coalesce("has", F.lit(False)))
    spine = spine.withColumn("without", F.max(~F.col("has")).over(Window.partitionBy("doc")))
    # whose links count: the own ones, and orphans where there are none, or everyone has some
    direct = spine.join(own, ["doc", "author"]).select("doc", "author", "n_authors", *places)
    shared = spine.where(~F.col("has") | ~F.col("without")).join(orphans.drop("author"), "doc").select("doc", "author", "n_authors", *places)
    taken = direct.unionByName(shared)
    per = taken.withColumn("n_links", F.count(F.lit(1)).over(Window.partitionBy("doc", "author")))
    weights = per.select("doc", *places, (1.0 / F.greatest("n_authors", F.lit(1)) / F.col("n_links")).alias("weight"))
    # authors, and documents, that took nothing
    took = taken.select(F.col("doc").alias("_d"), F.col("author").alias("_a")).distinct()
    none = spine.join(took, (F.col("doc") == F.col("_d")) & F.col("author").eqNullSafe(F.col("_a")), "left_anti")
    left = none.select("doc", *(F.lit(None).cast(links.schema[p].dataType).alias(p) for p in places), (1.0 / F.greatest("n_authors", F.lit(1))).alias("weight"))
    return weights.unionByName(left).groupBy("doc", *places).agg(F.sum("weight").alias("weight"))


def by_place(weights: DataFrame, place: str) -> DataFrame:
    """(place, weight, documents): fractional and whole counts of one kind of place."""
    return weights.where(F.col(place).isNotNull()).groupBy(place).agg(F.sum("weight").alias("weight"), F.countDistinct("doc").alias("documents"))


def coverage(weights: DataFrame, known: dict[str, str]) -> DataFrame:
    """One row: share of the weight for which each condition holds; an empty table gives 0."""
    total = F.sum("weight")
    return weights.agg(*(F.coalesce(F.try_divide(F.sum(F.when(F.expr(c), F.col("weight")).otherwise(0.0)), total), F.lit(0.0)).alias(n) for n, c in known.items()))


def institution_summary(weights: DataFrame, institution: str = "institution", state: str = "state") -> DataFrame:
    """(institution, weight, documents, state): totals, and the state with the most weight (then the least name)."""
    per_state = weights.groupBy(institution, state).agg(F.sum("weight").alias("w"))
    modal = per_state.where(F.col(state).isNotNull()).groupBy(institution).agg(F.min(F.struct((-F.col("w")).alias("w"), F.col(state).alias("s"))).alias("m")).select(institution, F.col("m.s").alias(state))
    totals = weights.groupBy(institution).agg(F.sum("weight").alias("weight"), F.countDistinct("doc").alias("documents"))
    return totals.where(F.col(institution).isNotNull()).join(modal, institution, "left")


def state_ladder(links: DataFrame, by_text: DataFrame, by_city: DataFrame) -> DataFrame:
    """Links with a decided state: stated, else where sources agree, else learned for the text, else for the city.

    ``links`` has (state_source, state_import, text, city); a conflict of the two
    sources is decided by what the corpus has learned, else left to the source.
    """
    learned = by_text.select(F.col("text"), F.col("state").alias("_text_state"))
    city = by_city.select(F.col("city"), F.col("state").alias("_city_state"))
    joined = links.join(learned, "text", "left").join(city, "city", "left")
    agreed = F.when(F.col("state_source").eqNullSafe(F.col("state_import")), F.col("state_source"))
    decided = F.coalesce(agreed, F.when(F.col("state_source").isNotNull() & F.col("state_import").isNotNull(), F.coalesce("_text_state", "state_source")), "state_source", "state_import", "_text_state", "_city_state")
    return joined.withColumn("state", decided).drop("_text_state", "_city_state")


def collaboration(members: DataFrame, by: str) -> DataFrame:
    """Per ``by``: share of documents with several authors, mean distinct authors, shares with several institutions and states, and home with abroad.

    ``members`` has (doc, by, author, institution, country, state). Each measure has
    its own denominator: documents for which the thing counted is known.
    """
    d = members.groupBy("doc", by).agg(
        F.countDistinct("author").alias("authors"),
        F.countDistinct("institution").alias("institutions"),
        F.countDistinct("state").alias("states"),
        F.max(F.col("home").cast("int")).alias("home"),
        F.max((~F.col("home")).cast("int")).alias("abroad"),
    )
    share = lambda n: F.avg(F.when(F.col(n) > 0, (F.col(n) > 1).cast("double")))
    return d.groupBy(by).agg(
        share("authors").alias("several_authors"),
        F.avg(F.when(F.col("authors") > 0, F.col("authors"))).alias("mean_authors"),
        share("institutions").alias("several_institutions"),
        share("states").alias("several_states"),
        F.avg(F.when(F.col("home").isNotNull(), ((F.col("home") == 1) & (F.col("abroad") == 1)).cast("double"))).alias("home_and_abroad"),
    )
