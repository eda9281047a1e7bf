"""Best-fit decreasing packing of token sequences, planned on size counts.

Documents of one length are interchangeable, so the plan needs only how many
pieces there are of each length, at most one count per possible length however
large the corpus. Best-fit decreasing is run on those counts on the driver, with
a segment tree over remaining capacities that finds the tightest open bin in
logarithmic time; bins with the same remaining capacity form runs of consecutive
numbers. The plan says which ranks of each length go where; ranks, and the
lookup of each piece in the plan, are computed by the executors.

Defined cases: a null or empty text is a document of its end id alone; only
documents longer than the capacity are cut, very long ones into as many pieces
as it takes; pieces of one length take the places of the length in any order;
repeated ids are separate documents, and a null id is kept as null; other
columns, whatever their names, are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .storage import stored
from .words import cached_tokenizer, id_and_text, raw_texts, slices


class CapacityTree:
    """Segment tree over remaining capacities 0..top that marks those with open bins."""

    def __init__(self, top: int):
        self.size = 1 << top.bit_length()
        self.marks = bytearray(2 * self.size)

    def mark(self, capacity: int, there: bool) -> None:
        node = self.size + capacity
        self.marks[node] = there
        while node > 1:
            node >>= 1
            self.marks[node] = self.marks[2 * node] | self.marks[2 * node + 1]

    def tightest(self, need: int) -> int | None:
        """Smallest marked capacity of at least ``need``."""
        node = self.size + need
        if self.marks[node]:
            return need
        while node > 1:
            if not node & 1 and self.marks[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node if self.marks[2 * node] else 2 * node + 1
                return node - self.size
            node >>= 1
        return None


def plan_best_fit(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, first bin, pieces per bin, offset), by length and rank.

    Equal to best-fit decreasing piece by piece: a piece goes to the open bin
    with the least room that takes it, and while that bin still takes another
    piece of the length it stays the tightest one.
    """
    tree = CapacityTree(capacity)
    runs: dict[int, list[list[int]]] = {}  # remaining capacity -> runs of [first bin, bins]
    rows, bins = [], 0

    def put(room: int, first: int, n: int) -> None:
        if room > 0 and n:
            runs.setdefault(room, []).append([first, n])
            tree.mark(room, True)

    for length in sorted(counts, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is not between 1 and {capacity}")
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, per = capacity, capacity // length
                n = -(-left // per)
                run = [bins, n]
                bins += n
            else:
                per = room // length
                run = runs[room].pop()
                if not runs[room]:
                    tree.mark(room, False)
            full = min(run[1], left // per)
            if full:
                rows.append((length, rank, run[0], per, capacity - room))
                put(room - per * length, run[0], full)
                rank, left = rank + full * per, left - full * per
            if left and full < run[1]:  # fewer are left than one more bin takes
                rows.append((length, rank, run[0] + full, left, capacity - room))
                put(room - left * length, run[0] + full, 1)
                rank, left, full = rank + left, 0, full + 1
            put(room, run[0] + full, run[1] - full)
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of whole documents: ids of the text, then the end id, cut only where too long.

    ``part`` and ``local`` number the pieces of each length within a task.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), Counter()
        tok, end, most = cached_tokenizer(tokenizer), struct.pack("<I", end_id), 4 * capacity
        for batch in slices(batches):
            rows = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), tok.packed_batch(raw_texts(batch.column("text"))), strict=True):
                ids += end
                for k in range(0, len(ids), most):
                    own = ids[k : k + most]
                    n = len(own) // 4
                    rows.append((doc, k // most, k // 4, n, zlib.crc32(own), part, seen[n], *([np.frombuffer(own, "<u4").astype(np.int32)] if with_ids else [])))
                    seen[n] += 1
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "local", "ids"]
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=False)], names=names[: len(columns)])

    return id_and_text(docs, id_col, text_col).mapInArrow(cut, PIECES + ", part int, local long" + (", ids array<int>" if with_ids else ""))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Place every piece: the columns of PIECES, sequence_id and offset (and ids if asked).

    Two passes over narrow rows: the pieces are written once, so that ranks stay
    the same if a task runs again; a piece's rank within its length is its number
    within its task plus the pieces of the length in earlier tasks. No task ever
    holds all pieces of a length, however common the length is.
    """
    spark = docs.sparkSession
    pieces = stored(token_pieces(docs, tokenizer, capacity, end_id, id_col, text_col, with_ids), "pieces")
    tally = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    counts = {r.length: r.n for r in tally.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    before = tally.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    ranked = pieces.join(before, ["length", "part"]).withColumn("rank", F.col("before") + F.col("local"))
    plan = plan_best_fit(counts, capacity)
    if plan.nbytes > 256 << 20:  # at most capacity**2 / 2 rows of 40 bytes: 84 MB for 2,048
        raise ValueError(f"a plan of {plan.nbytes} bytes is too large to broadcast; lower the capacity")
    shared = spark.sparkContext.broadcast(plan)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = shared.value
        bound = 1 << 44  # ranks stay below it
        keys = rows[:, 0] * bound + rows[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            own = rows[np.searchsorted(keys, length * bound + rank, side="right") - 1]
            into = rank - own[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(x) for x in names), pa.array(own[:, 2] + into // own[:, 3]), pa.array(own[:, 4] + into % own[:, 3] * length)],
                names=[*names, "sequence_id", "offset"],
            )

    return ranked.select(*names, "rank").mapInArrow(place, PIECES + (", ids array<int>" if with_ids else "") + ", sequence_id long, offset long")
