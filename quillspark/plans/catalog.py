"""SQL over a project's tables: views for the stages that ran, coverage, and run records."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.schemas import ASSIGNMENTS, CLASSIFICATIONS, DOCUMENT, LINKS, WEIGHTS, struct
from quillspark.sources.sinks import materialise

OPTIONAL = {"assignments": ASSIGNMENTS, "links": LINKS, "weights": WEIGHTS, "network_people": None, "network_edges": None, "network_communities": None, "network_citations": None}


def _exists(spark: SparkSession, path: str) -> bool:
    """Asked of the path's own filesystem, whichever it is."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def documents(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(struct(DOCUMENT)).parquet(f"{root}/documents.parquet")


def register(spark: SparkSession, root: str) -> list[str]:
    """Temp views over a project folder: documents, texts, authors, affiliations, and whatever stages have written."""
    docs = documents(spark, root)
    views = {
        "documents": docs,
        "texts": docs.select("id", F.lit("title").alias("kind"), F.inline("titles")).unionByName(docs.select("id", F.lit("abstract").alias("kind"), F.inline("abstracts"))),
        "authors": docs.select("id", F.posexplode("authors").alias("_at", "_a")).select("id", (F.col("_at") + 1).alias("position"), "_a.*"),
        "affiliations": docs.select(F.col("id").alias("doc"), F.inline("affiliations")),
    }
    for name, ddl in OPTIONAL.items():
        if _exists(spark, f"{root}/{name}.parquet"):
            reader = spark.read.schema(struct(ddl)) if ddl else spark.read
            views[name] = reader.parquet(f"{root}/{name}.parquet")
    if _exists(spark, f"{root}/classifications"):
        views["classifications"] = with_run(spark, f"{root}/classifications")
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return sorted(views)


def with_run(spark: SparkSession, folder: str) -> DataFrame:
    """All classification runs of a folder; the run is the name of the file or folder the row came from."""
    df = spark.read.schema(struct(CLASSIFICATIONS)).option("recursiveFileLookup", "true").parquet(folder)
    return df.withColumn("run", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)[.]parquet", 1))


def query(spark: SparkSession, root: str, sql: str, form: str = "dicts"):
    """Register the views and run any SQL."""
    register(spark, root)
    return materialise(spark.sql(sql), form)


def coverage(docs: DataFrame) -> DataFrame:
    """One row of counts over the corpus, in one pass."""
    has = lambda c: F.count_if(F.coalesce(F.size(c), F.lit(0)) > 0)
    return docs.agg(
        F.count(F.lit(1)).alias("documents"),
        F.min("year").alias("first_year"),
        F.max("year").alias("last_year"),
        F.countDistinct(F.coalesce("journal_acronym", "journal_issn", F.lit("?"))).alias("journals"),
        F.count("doi").alias("with_doi"),
        F.count("work").alias("with_work"),
        has("titles").alias("with_title"),
        has("abstracts").alias("with_abstract"),
        has("keywords").alias("with_keywords"),
        has("authors").alias("with_authors"),
        has("affiliations").alias("with_affiliations"),
        F.count("licence").alias("with_licence"),
        F.count("possible_duplicate_of").alias("suspected"),
    )


def record_run(spark: SparkSession, root: str, stage: str, counts: dict[str, int], signature: str) -> None:
    """Append one row: a stage's counts, the hash of its inputs, and the time."""
    row = [(stage, {k: int(v) for k, v in counts.items()}, signature, time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()))]
    spark.createDataFrame(row, "stage string, counts map<string,long>, signature string, finished string").write.mode("append").json(f"{root}/runs")


def signature(df: DataFrame) -> str:
    """A hash of the rows that does not depend on their order, for telling whether a stage's inputs changed."""
    h = df.select(F.xxhash64(*df.columns).alias("h")).agg(F.count(F.lit(1)).alias("n"), F.bit_xor("h").alias("x"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s"))
    return h.select(F.sha2(F.concat_ws("|", "n", "x", "s"), 256).alias("signature")).first().signature


def is_fresh(spark: SparkSession, root: str, stage: str, now: str) -> bool:
    """Whether the last run of a stage saw the same inputs."""
    if not _exists(spark, f"{root}/runs"):
        return False
    runs = spark.read.schema("stage string, counts map<string,long>, signature string, finished string").json(f"{root}/runs")
    last = runs.where(F.col("stage") == stage).orderBy(F.desc("finished")).first()
    return bool(last and last.signature == now)
