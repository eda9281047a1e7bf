"""Corpus pipeline: language ID, quality rules, SimHash near-dedup, best-fit packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept.
The first three return documents with the columns they came with; the last
returns the packed pieces. Models are fitted on the documents a stage is given.

Defined cases: null and empty texts go with the language stage, as do texts
without letters; rows that repeat the id that stays of their group are one
document and one of them stays; an empty table passes through empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import best_fit, language_id, quality, simhash
from quillspark.llm.queries import PIECE_VOCABULARY, WORD_VOCABULARY, table
from quillspark.llm.storage import drop, new_folder, scope
from quillspark.llm.words import public_vocabulary

#: Documents whose language is less certain are rejected.
LEAST_LANGUAGE_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; those without letters or of no clear language go."""
    vocabulary = public_vocabulary(PIECE_VOCABULARY)
    return language_id.keep_identified(docs, language_id.train(docs, vocabulary), vocabulary, LEAST_LANGUAGE_SCORE)


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the calibrated model."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id."""
    return simhash.one_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in the sequences."""
    return best_fit.pack_documents(docs, public_vocabulary(WORD_VOCABULARY))


STAGES = [
    ("language_id", identify_language),
    ("quality_rules", apply_quality_rules),
    ("simhash_near_dedup", drop_near_duplicates),
    ("best_fit_packing", pack),
]

#: SQL cannot express the models and the fingerprints.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written and read again as the next one's input."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        folder = new_folder(spark, f"stage-{name}")
        with scope():  # what the stage's operator writes on its way goes with the stage
            stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
        if before:
            drop(before)
        before = folder
    return docs
