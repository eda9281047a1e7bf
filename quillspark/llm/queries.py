"""Queries of the training-data operators, with production parameters on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import best_fit, chat, cover_tree, language_id, piece_codec, quality, simhash, token_counts, token_files, warc
from .words import public_vocabulary

WORD_VOCABULARY = "word_bpe_49k.json"
PIECE_VOCABULARY = "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.pages_of(warc.read_warc(spark, warc.write_warc(table(spark, sf_dir, "pages")), payload=False))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, vocabulary = table(spark, sf_dir, "documents"), public_vocabulary(PIECE_VOCABULARY)
    return language_id.identify(docs, language_id.train(docs, vocabulary), vocabulary)


def op3_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.round_trip(table(spark, sf_dir, "documents"), public_vocabulary(PIECE_VOCABULARY))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack_documents(table(spark, sf_dir, "documents"), public_vocabulary(WORD_VOCABULARY))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.top_k(table(spark, sf_dir, "embeddings"), k=10, every=100)


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(table(spark, sf_dir, "conversations"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.write_token_files(table(spark, sf_dir, "documents"), public_vocabulary(WORD_VOCABULARY))
    return token_files.read_token_files(spark, folder)


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_vocabulary(PIECE_VOCABULARY))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_warc": op2_warc,
    "op3_sentencepiece_codec": op3_sentencepiece_codec,
    "op4_language_id": op4_language_id,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_exact_top_k": op6_exact_top_k,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_token_files": op8_token_files,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op10_token_counts": op10_token_counts,
}

#: Where SQL can express the query.
ORACLES: dict[str, str] = {
    "op6_exact_top_k": """
        WITH usable AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        scored AS (
            SELECT q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(q.v, d.v) AS BIGINT) AS score
            FROM usable q JOIN usable d ON q.vec_id <> d.vec_id
            WHERE q.vec_id % 100 = 0
        ),
        ranked AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored
        )
        SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 10
    """,
    "op7_chat_formatting": """
        WITH turns AS (
            SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
            FROM conversations WHERE conv_id IS NOT NULL
        ),
        numbered AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) AS position FROM turns
        ),
        chats AS (
            SELECT conv_id, count(*) AS n_turns, list({'role': role, 'text': text} ORDER BY position) AS body
            FROM numbered GROUP BY conv_id
        ),
        kept AS (
            SELECT a.conv_id, a.n_turns FROM chats a
            WHERE NOT EXISTS (
                SELECT 1 FROM chats b
                WHERE b.conv_id <> a.conv_id AND b.body[1:a.n_turns] = a.body
                  AND (b.n_turns > a.n_turns OR b.conv_id < a.conv_id)
            )
        ),
        pieces AS (
            SELECT conv_id, n_turns, position, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS rendered
            FROM numbered JOIN kept USING (conv_id)
        )
        SELECT conv_id, n_turns, position,
               CAST(coalesce(sum(length(rendered)) OVER (PARTITION BY conv_id ORDER BY position
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
               rendered
        FROM pieces
    """,
}
