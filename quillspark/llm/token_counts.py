"""Token counts of whole texts by a count-only Viterbi.

Defined cases: a null or empty text has 0 tokens; of equal sums the longest last
piece wins, as in the encoder; a very long text is counted whole; a null id is
kept as null; repeated rows are separate documents; other columns, whatever
their names, are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .pieces import cached_pieces
from .words import id_and_text, raw_texts, slices


def token_counts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens): as many as the encoder gives ids, without making them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = cached_pieces(model)
        for batch in slices(batches):
            counts = [codec.count(t) for t in raw_texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long")
