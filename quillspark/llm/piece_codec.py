"""Encoding whole texts into pieces and back, by automaton and Viterbi.

Defined cases: a null or empty text has no ids and decodes to the empty text;
U+2581 in a text is the model's own sign for a space and decodes to a space; of
equal sums the longest last piece wins; a very long text is encoded whole, part
by part; a null id is kept as null; repeated rows are separate documents; other
columns, whatever their names, are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .pieces import cached_pieces
from .words import id_and_text, raw_texts, slices


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = cached_pieces(model)
        for batch in slices(batches):
            packed = [codec.packed(t) for t in raw_texts(batch.column("text"))]
            ends = np.cumsum([0, *(len(x) // 4 for x in packed)])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(packed), "<i4")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], names=["doc_id", "ids"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of every row of ids; null ids give the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = cached_pieces(model).model
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [pieces.decode(x or ()) for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())], names=["doc_id", "text"])

    own = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return own.mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_ids, ids_crc32, text_crc32, exact): digests of each text's ids and of the text decoded from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = cached_pieces(model)
        for batch in slices(batches):
            texts = raw_texts(batch.column("text"))
            packed = [codec.packed(t) for t in texts]
            back = [codec.model.decode(np.frombuffer(x, "<u4").tolist()) for x in packed]
            columns = [
                pa.array([len(x) // 4 for x in packed], pa.int64()),
                pa.array(map(zlib.crc32, packed), pa.int64()),
                pa.array(map(zlib.crc32, back), pa.int64()),
                pa.array([a == b for a, b in zip(texts, back, strict=True)], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "n_ids", "ids_crc32", "text_crc32", "exact"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, text_crc32 long, exact boolean")
