"""The project API: one folder of tables, stages that write into it, SQL over it."""

from __future__ import annotations

import fcntl
import os
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.functions import codebook, statistics, text, trend
from quillspark.operators import citations, counting, graph, relational, resolve, terms, vectors, voting
from quillspark.plans import catalog
from quillspark.schemas import CLASSIFICATIONS, DOCUMENT, struct
from quillspark.sources import importers, sinks


def years(text_: str) -> tuple[int, int]:
    """``2024`` or ``2010-2025``."""
    lo, _, hi = text_.strip().partition("-")
    first, last = int(lo), int(hi or lo)
    if not 1000 <= first <= last <= 9999:
        raise ValueError(f"not a range of years: {text_}")
    return first, last


class Project:
    """A project folder. Stages record a signature of their inputs, so they can tell whether they are fresh."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # ---- tables ----

    def path(self, name: str) -> str:
        return f"{self.root}/{name}.parquet"

    def has(self, name: str) -> bool:
        return catalog._exists(self.spark, self.path(name))

    def read(self, name: str) -> DataFrame:
        return catalog.documents(self.spark, self.root) if name == "documents" else self.spark.read.parquet(self.path(name))

    def write(self, name: str, df: DataFrame, keys: list[str]) -> DataFrame:
        sinks.write_table(df, self.path(name), keys)
        return self.read(name)

    def query(self, sql: str, form: str = "dicts"):
        return catalog.query(self.spark, self.root, sql, form)

    def coverage(self) -> dict:
        return catalog.coverage(self.read("documents")).first().asDict()

    def stages(self) -> dict[str, bool]:
        return {s: self.has(s) for s in ("documents", "links", "weights", "network_edges", "assignments")}

    @contextmanager
    def lock(self) -> Iterator[None]:
        """One stage at a time on this machine's view of a local project folder."""
        folder = Path(self.root.removeprefix("file://"))
        folder.mkdir(parents=True, exist_ok=True)
        with open(folder / ".lock", "w") as f:
            fcntl.flock(f, fcntl.LOCK_EX)
            try:
                yield
            finally:
                fcntl.flock(f, fcntl.LOCK_UN)

    def stage(self, name: str, inputs: list[DataFrame], run: Callable[[], dict[str, int]]) -> bool:
        """Run a stage unless its inputs are those of its last run; returns whether it ran."""
        now = "|".join(catalog.signature(d) for d in inputs)
        with self.lock():
            if catalog.is_fresh(self.spark, self.root, name, now):
                return False
            catalog.record_run(self.spark, self.root, name, run(), now)
        return True

    # ---- stages ----

    def collect(self, documents: DataFrame, first_source: str, kinds: list[str] | None = None, period: str | None = None, exclude: DataFrame | None = None) -> dict[str, int]:
        """Filter by kind and year, exclude, deduplicate and write the corpus: exclusion comes before duplicates."""
        docs = documents.select([f.name for f in struct(DOCUMENT)])
        counts = {"read": docs.count()}
        if kinds:
            docs, rejects = relational.whitelisted(docs, "kind", kinds)
            self.write("rejected_kinds", rejects, ["kind"])
        if period:
            docs = docs.where(F.col("year").between(*years(period)))
        if exclude is not None:
            docs, unmatched = relational.excluded(docs, exclude, ["id", "pid", "doi", "work"])
            counts["unmatched_exclusions"] = unmatched.count()
        flat = docs.select("id", "source", "pid", "doi", "year", F.try_element_at("titles", F.lit(1))["text"].alias("title"), F.try_element_at("authors", F.lit(1))["surname"].alias("surname"))
        kept = resolve.deduplicate(flat, first_source)
        merged = resolve.merge(docs, kept, (F.col("id") != F.col("kept")).cast("int"))
        suspected = kept.where("suspected IS NOT NULL").select("id", F.col("suspected").alias("_s"))
        out = merged.join(suspected, "id", "left").withColumn("possible_duplicate_of", F.coalesce("_s", "possible_duplicate_of")).drop("_s")
        counts["written"] = self.write("documents", out, ["id"]).count()
        return counts

    def networks(self) -> dict[str, int]:
        """People's co-authorship: pairs with weights, communities and metrics."""
        authors = self.read("documents").select(F.col("id").alias("doc"), F.explode("authors").alias("a")).select("doc", F.array_join(resolve.name_parts(F.concat_ws(" ", "a.given", "a.surname")), " ").alias("member"))
        edges = self.write("network_edges", graph.weighted_pairs(authors, "doc", "member"), ["a", "b"])
        groups = graph.numbered_communities(graph.louvain(edges))
        self.write("network_communities", groups, ["community", "node"])
        counts = {"edges": edges.count(), "people": groups.count()}
        if self.has("weights"):  # the other networks need the places of the links
            links = self.read("weights")
            for name, member in (("institutions", "institution"), ("states", "state")):
                pairs = self.write(f"network_{name}", graph.weighted_pairs(links.where(F.col(member).isNotNull()), "doc", member), ["a", "b"])
                counts[name] = pairs.count()
        return counts

    def geography(self, links: DataFrame) -> dict[str, int]:
        """Fractional weights of (doc, author, institution, state, country) links."""
        docs = self.read("documents").select(F.col("id").alias("doc"), F.coalesce(F.size("authors"), F.lit(0)).alias("n_authors"))
        w = counting.fractional(docs, links, ["institution", "state", "country"])
        return {"weights": self.write("weights", w, ["doc", "institution", "state", "country"]).count()}

    def topics(self, embeddings: DataFrame, least_similarity: float = 0.5, k: int = 15) -> dict[str, int]:
        """Clusters of embeddings (id, vector), noise reassigned by neighbours' votes, and keywords."""
        near = vectors.nearest(embeddings, embeddings, "id", "vector", k)
        labels = vectors.density_clusters(near, embeddings, "id", least_similarity, 3, 10)
        open_ = labels.withColumn("label", F.when(F.col("label") >= 0, F.col("label")))
        extra = vectors.reassign(near, open_, "id", "label").withColumnRenamed("label", "voted")
        topics = open_.join(extra, "id", "left").select("id", F.coalesce("label", "voted", F.lit(-1)).alias("topic"), F.when(F.col("label").isNotNull(), "core").when(F.col("voted").isNotNull(), "reassigned").otherwise("none").alias("assignment"))
        written = self.write("topics", topics, ["id"])
        body = self.read("documents").select("id", F.concat_ws(" ", text.preferred_text(F.col("titles"), ["pt", "en"])["text"], text.preferred_text(F.col("abstracts"), ["pt", "en"])["text"]).alias("text"))
        named = body.join(written, "id").withColumn("topic", F.when(F.col("topic") >= 0, F.col("topic")))
        self.write("topic_keywords", terms.keywords(terms.class_tfidf(named, "id", "topic", "text"), "topic"), ["topic", "rank"])
        return {"documents": written.count()}

    def trends(self) -> DataFrame:
        docs = self.read("documents").select("id", "year")
        totals = docs.groupBy("year").agg(F.count(F.lit(1)).alias("total"))
        counts = docs.join(self.read("topics").where("topic >= 0"), "id").groupBy("topic", "year").agg(F.count(F.lit(1)).alias("n"))
        return trend.trends(relational.dense_series(counts, "topic", "year", "n", totals).join(totals, "year"), "topic")

    def classify(self, texts: DataFrame, provider: Callable[[str], dict[str, str]], run: str) -> dict[str, int]:
        """Ask a provider about every pending text (doc, text); quotes are checked, results appended to the run.

        The provider is any function from a text to {variable: (value, quote)};
        it is called inside the executors, in Arrow batches.
        """
        import pandas as pd

        folder = f"{self.root}/classifications/{run}.parquet"
        done = self.spark.read.parquet(folder).select("doc").distinct() if catalog._exists(self.spark, folder) else None
        todo = voting.pending(texts, done, ["doc"]) if done is not None else texts

        names = struct(CLASSIFICATIONS).names

        def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                out = []
                for doc, body in f[["doc", "text"]].itertuples(index=False):
                    for variable, (value, quote) in provider(body).items():
                        status, where, a, b = text.check_evidence(quote or "", body)
                        out.append((doc, variable, value, quote, status, where, a, b, 1, True, 0.0))
                yield pd.DataFrame(out, columns=names).astype({"start": "Int32", "end": "Int32"})

        todo.select("doc", "text").mapInPandas(ask, CLASSIFICATIONS).write.mode("append").parquet(folder)
        return {"asked": todo.count() if done is None else texts.count() - done.count()}

    def classify_by_codebook(self, texts: DataFrame, variables: list[codebook.Variable], provider: Callable[[str, list[str]], object], run: str, tries: int = 2) -> dict[str, int]:
        """Ask a provider about every text (doc, text) that the run's answers do not cover yet.

        ``provider(text, problems)`` gives ``{variable: {value, quote}}``; an answer
        that the codebook refuses is asked for again with what was wrong, and the
        best of the tries is kept. Answers are stored under a hash of the text and
        the codebook, so a changed text or codebook is asked about again, and an
        interrupted run goes on where it stopped.
        """
        import pandas as pd

        folder = f"{self.root}/answers/{run}.parquet"
        book = repr(variables)
        keyed = texts.select("doc", "text", F.sha2(F.concat_ws("|", F.lit(book), "text"), 256).alias("key"))
        todo = voting.pending(keyed, self.spark.read.parquet(folder), ["doc", "key"]) if catalog._exists(self.spark, folder) else keyed
        columns = ["doc", "key", "variable", "kind", "value", "quote", "status", "field", "start", "end", "tries", "problems"]

        def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                out = []
                for doc, body, key in f[["doc", "text", "key"]].itertuples(index=False):
                    answers: list[codebook.Answer] = []
                    while len(answers) < tries and (not answers or answers[-1].problems):
                        answers.append(codebook.check_answer(provider(body, answers[-1].problems if answers else []), variables))
                    best = codebook.best_of(answers)
                    for v in variables:
                        if v.id in best.values:
                            place = text.check_evidence(best.quotes[v.id], body, nothing_stated=codebook.states_nothing(v, best.values[v.id]))
                            out.append((doc, key, v.id, v.kind, codebook.as_text(best.values[v.id]), best.quotes[v.id], *place, len(answers), len(best.problems)))
                yield pd.DataFrame(out, columns=columns).astype({"start": "Int32", "end": "Int32", "tries": "int32", "problems": "int32"})

        schema = "doc string, key string, variable string, kind string, value string, quote string, status string, field string, start int, end int, tries int, problems int"
        before = todo.count()
        todo.select(F.col("doc").cast("string").alias("doc"), "text", "key").mapInPandas(ask, schema).write.mode("append").parquet(folder)
        return {"asked": before}

    def validate(self, answers: DataFrame, a: str, b: str) -> dict:
        """Agreement of two raters' columns of one table."""
        return statistics.agreement(answers, a, b).first().asDict()

    def citations(self, references: DataFrame) -> DataFrame:
        docs = self.read("documents").select(F.col("id").alias("doc"), "work", "year")
        return self.write("network_citations", citations.split_references(references, docs), ["doc", "cited"])

    def publish(self, folder: str, tables: dict[str, tuple[DataFrame, list[str]]]) -> None:
        """Columnar JSON of small tables; refuses while any text holds an address."""
        for name, (df, _) in tables.items():
            strings = [f.name for f in df.schema if f.dataType.simpleString() == "string"]
            if n := sinks.private_rows(df, strings) if strings else 0:
                raise ValueError(f"{n} rows of {name} hold an address")
        sinks.write_contract({name: sinks.columnar(df, keys) for name, (df, keys) in tables.items()}, folder)


def open_project(spark: SparkSession, root: str) -> Project:
    return Project(spark, root)


def import_documents(spark: SparkSession, path: str) -> DataFrame:
    return importers.read_export(spark, os.fspath(path))
