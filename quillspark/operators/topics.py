"""Topics across runs: numbers, macro themes and labels that stay, and embeddings that are made once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .relational import assignment, jaccard, stable_numbers
from .vectors import dot, normalised

#: Least shared part of two topics' documents, and of two lists of keywords; share of matched topics from which macro themes stay.
LEAST_OVERLAP, LEAST_KEYWORDS, PERSISTENT_SHARE = 0.3, 0.5, 0.5
#: Keywords by which a topic's label is recognised.
KEYWORDS = 10


def match_topics(before: DataFrame, now: DataFrame, least: float = LEAST_OVERLAP) -> DataFrame:
    """(topic, old, jaccard): new topics (doc, topic) one to one with old ones, by their documents of both runs."""
    both = before.select("doc", F.col("topic").alias("old")).join(now.select("doc", F.col("topic").alias("topic")), "doc")
    return assignment(jaccard(both, "topic", "old"), "topic", "old", "jaccard", least)


def number_topics(now: DataFrame, matches: DataFrame, next_id: int) -> DataFrame:
    """(group, id): matched topics keep their number, others get new ones by falling size; none is used again."""
    sizes = now.groupBy(F.col("topic").alias("group")).agg(F.count(F.lit(1)).alias("size"))
    return stable_numbers(sizes, matches.select(F.col("topic").alias("group"), F.col("old").cast("int").alias("id")), next_id)


def persistent_macros(topics: DataFrame, matches: DataFrame, old: DataFrame, centres: DataFrame, clustered: DataFrame, share: float = PERSISTENT_SHARE) -> DataFrame:
    """(topic, macro): the macro theme of each new topic.

    If enough of the topics are matched, those keep the macro theme of their old
    topic (``old`` has (old, macro)), and each other goes to that of the matched
    topic whose centre (topic, centre) is most like its own, of equal ones the
    least. Otherwise the themes are those of ``clustered`` (topic, macro).
    """
    kept = matches.join(old, "old").select("topic", "macro")
    if kept.count() < share * topics.count():
        return clustered.select("topic", "macro")
    c = centres.select("topic", normalised(F.col("centre")).alias("v"))
    new = topics.select("topic").join(kept, "topic", "left_anti").join(c, "topic")
    near = new.crossJoin(kept.join(c.select("topic", F.col("v").alias("w")), "topic").select(F.col("topic").alias("like"), "macro", "w"))  # tens of topics
    best = near.groupBy("topic").agg(F.min(F.struct((-F.round(dot(F.col("v"), F.col("w")), 9)).alias("s"), "like", "macro"))["macro"].alias("macro"))
    return kept.unionByName(best)


def reusable_labels(matches: DataFrame, old_words: DataFrame, new_words: DataFrame, labels: DataFrame, least: float = LEAST_KEYWORDS) -> DataFrame:
    """(topic, label): labels (old, label) of matched topics whose first keywords (topic, term, rank) are still much the same."""
    a = old_words.where(F.col("rank") <= KEYWORDS).select(F.col("topic").alias("old"), "term")
    b = new_words.where(F.col("rank") <= KEYWORDS).select("topic", "term")
    sizes = lambda df, key, name: df.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    shared = matches.select("topic", "old").join(a, "old").join(b, ["topic", "term"]).groupBy("topic", "old").agg(F.count(F.lit(1)).alias("k"))
    like = shared.join(sizes(a, "old", "na"), "old").join(sizes(b, "topic", "nb"), "topic").where(F.col("k") >= least * (F.col("na") + F.col("nb") - F.col("k")))
    return like.join(labels, "old").select("topic", "label")


def embed(texts: DataFrame, cache: str, make: Callable[[list[str]], list[list[float]]], model: str, batch: int = 512) -> DataFrame:
    """(id, vector) of texts (id, text): made once for each id, text and model, and kept in a table.

    ``make`` gets batches of texts inside the executors. What a stopped run has
    not written is made by the next one.
    """
    from quillspark.plans.catalog import _exists

    spark = texts.sparkSession
    key = F.sha2(F.concat_ws("|", F.lit(model), "text"), 256)
    own = texts.select(F.col("id").cast("string").alias("id"), "text", key.alias("key"))
    there = _exists(spark, cache)
    todo = own.join(spark.read.parquet(cache).select("id", "key"), ["id", "key"], "left_anti") if there else own

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), batch):
                some = f.iloc[at : at + batch]
                yield pd.DataFrame({"id": some["id"], "key": some["key"], "vector": make(some["text"].tolist())})

    todo.where("text IS NOT NULL").mapInPandas(run, "id string, key string, vector array<double>").write.mode("append").parquet(cache)
    return own.select("id", "key").join(spark.read.parquet(cache), ["id", "key"]).select("id", "vector").dropDuplicates(["id"])
