"""SimHash near-duplicates: segment-popcount embedding, grid range-join, exact check.

A fingerprint is embedded as the bit counts of its 32 two-bit segments. The
Manhattan distance of two embeddings never exceeds the Hamming distance, so
fingerprints at ``distance`` 4 or less have, in the embedding of one of their two
halves, a Manhattan distance of 2 or less; and two grid points that far apart
share a cell if each is put into its own cell and those one step away. The join
is therefore an equality join on (half, cell), about 50 narrow rows for each
different fingerprint, and every pair met is checked bit by bit.

Equal fingerprints are one point, so copies never meet each other in the join.
Within a cell only a spanning forest of the links is emitted: components stay
those of all links, and a group of near copies gives no quadratic output. Cells
around one that holds more than its share of points are dealt out by parts of
their half: of three parts, two that differ in at most two bits share one.

Defined cases: a text without words, an empty or a null text has fingerprint
zero and is linked like any other; fewer words than a shingle form one shingle;
a bit set in exactly half of the hashes is 0; a very long text is hashed whole,
in runs of shingles; repeated rows are separate documents with one component;
rows with a null id get a null component unless they share a fingerprint with,
or link to, an id; other columns, whatever their names, are not looked at by
``near_duplicates`` and come back as they were from ``one_of_each``; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .components import connected_components
from .skew import free_name, join_by_key
from .storage import stored
from .words import id_and_text, raw_texts, slices

SEED, BITS = 42, 64


def text_fingerprint(text: bytes, words: int = 4) -> int:
    """Signed 64-bit SimHash: a bit is set if it is set in over half of the shingles' XXH64."""
    from xxhash import xxh64_intdigest

    own = text.lower().split()  # bytes: only A-Z, and only ASCII white space
    if not own:
        return 0
    shingles = zip(*(own[i:] for i in range(words)), strict=False) if len(own) >= words else [own]
    n = max(1, len(own) - words + 1)
    hashes = np.fromiter(map(xxh64_intdigest, map(b" ".join, shingles), repeat(SEED)), dtype="<u8", count=n)
    counts = np.zeros(BITS, dtype=np.int64)
    for i in range(0, n, 1 << 15):
        counts += np.unpackbits(hashes[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = [text_fingerprint(t, words) for t in raw_texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def _cells(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) of the own cell and all cells one step away, for 32-bit halves.

    A cell is the 16 counts, two bits each; steps stay within 0..2, as some
    point between two embeddings always does.
    """
    return _around(half - ((half >> 1) & 0x55555555))


def _around(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) of the given cells and all cells one step away."""
    rows, cells = [np.arange(len(own))], [own]
    for at in range(0, 32, 2):
        count = (own >> at) & 3
        for step, can in ((1, count < 2), (-1, count > 0)):
            hit = np.flatnonzero(can)
            rows.append(hit)
            cells.append(own[hit] + (step << at))
    return np.concatenate(rows), np.concatenate(cells)


#: Cells with more own points than this, and than their share of all points, are heavy.
HEAVY_CELL, HEAVY_CELLS = 50_000, 65_536
#: First bit and width of the three parts of a half.
PARTS = ((0, 11), (11, 11), (22, 10))
#: Bits of a grid row's key that tell the parts of a heavy cell apart.
PART_BITS = 13


def heavy_cells(points: DataFrame, total: int) -> np.ndarray:
    """Cells that take points of a heavy own cell, sorted.

    Every heavy cell has over ``1 / HEAVY_CELLS`` of the 2 x ``total`` own cells, so
    there are less than that many, and at most 33 times as many around them:
    17 MB, whatever the table. A cell that is not listed holds at most 33 times
    the share of points.
    """
    most = max(HEAVY_CELL, 2 * total // HEAVY_CELLS)
    if total <= most:
        return np.zeros(0, dtype=np.int64)
    low = F.lit(0xFFFFFFFF)
    halves = points.select(F.explode(F.array(F.struct(F.lit(0).alias("half"), F.col("fp").bitwiseAND(low).alias("bits")), F.struct(F.lit(1).alias("half"), F.shiftrightunsigned("fp", 32).alias("bits")))).alias("x"))
    own = (F.col("x.bits") - F.shiftright("x.bits", 1).bitwiseAND(F.lit(0x55555555))).alias("own")
    found = halves.groupBy(F.col("x.half").alias("half"), own).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("half", "own").collect()
    out = [np.zeros(0, dtype=np.int64)]
    for r in found:
        around = np.array([r.own], dtype=np.int64)
        out.append(_around(around)[1] + (r.half << 32))
    return np.unique(np.concatenate(out))


def grid_rows(points: DataFrame, heavy: np.ndarray | None = None) -> DataFrame:
    """(cell, fp, node) for both halves of every point (fp, node); heavy cells in parts."""
    heavy = np.zeros(0, dtype=np.int64) if heavy is None else heavy
    shared = points.sparkSession.sparkContext.broadcast(heavy) if len(heavy) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = shared.value if shared else None
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                fp, node = part.column("fp").to_numpy(), part.column("node").to_numpy()
                for half in (0, 1):
                    bits = (fp >> (32 * half)) & 0xFFFFFFFF
                    rows, cells = _cells(bits)
                    keys = (cells + (half << 32)) << PART_BITS
                    if hot is not None:
                        at_hot = hot[np.minimum(np.searchsorted(hot, cells + (half << 32)), len(hot) - 1)] == cells + (half << 32)
                        own, key = rows[at_hot], keys[at_hot]
                        split = [key + 1 + (k << 11) + ((bits[own] >> first) & ((1 << width) - 1)) for k, (first, width) in enumerate(PARTS)]
                        rows, keys = np.concatenate((rows[~at_hot], *(own for _ in PARTS))), np.concatenate((keys[~at_hot], *split))
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fp[rows]), pa.array(node[rows])], names=["cell", "fp", "node"])

    return points.mapInArrow(run, "cell long, fp long, node long")


class _Forest:
    """Union-find over the nodes that one task has linked so far."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _by_leaders(fp: np.ndarray, left: np.ndarray, distance: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray] | np.ndarray]:
    """Links around at most ``most`` leaders of the points ``left``; last, the points still open.

    A leader's near points are one component. By the triangle inequality only
    points within twice the distance of the leader can link to them, one link
    each is enough, and the leader's near points then need no further look.
    """
    for _ in range(most):
        if len(left) < 2:
            break
        far = np.bitwise_count(fp[left] ^ fp[left[0]])
        near, ring = left[far <= distance], left[(far > distance) & (far <= 2 * distance)]
        if len(near) > 1:
            yield np.full(len(near) - 1, near[0]), near[1:]
        for at in range(0, len(ring), 256):
            some = ring[at : at + 256]
            seen = np.zeros(len(some), dtype=bool)
            for k in range(0, len(near), 4096):
                part = near[k : k + 4096]
                hit = np.bitwise_count(fp[some][:, None] ^ fp[part][None, :]) <= distance
                any_hit = hit.any(axis=1) & ~seen
                if any_hit.any():
                    yield part[hit.argmax(axis=1)[any_hit]], some[any_hit]
                    seen |= any_hit
        left = left[far > distance]
    yield left


#: Longer runs of one cell are searched by leaders, and what is left by blocks of bits, instead of by all offsets.
LONG_RUN = 256
LEADERS = 32


def _links(cell: np.ndarray, fp: np.ndarray, distance: int, depth: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (i, j) within cells of rows sorted by cell.

    Crowded points of a long run are taken out by leaders. The others are sorted
    by each of ``distance`` + 1 blocks of bits in turn: two fingerprints within
    the distance are equal in one of them, so all pairs lie within runs of equal
    blocks, which are far shorter. Deeper, the blocks begin at other bits.
    """
    starts = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    sizes = np.diff(np.append(starts, len(cell)))
    for s, n in zip(starts[sizes > LONG_RUN], sizes[sizes > LONG_RUN], strict=True):
        left = np.arange(s, s + n)
        for found in _by_leaders(fp, left, distance, LEADERS if depth < 3 else n):
            if isinstance(found, tuple):
                yield found
            else:
                left = found
        if len(left) < 2:
            continue
        turn = np.uint64(1 + 6 * depth)
        bits = fp[left] >> turn | fp[left] << (np.uint64(64) - turn)
        width = -(-BITS // (distance + 1))
        for at in range(0, BITS, width):
            block = bits >> np.uint64(at) & np.uint64((1 << min(width, BITS - at)) - 1)
            order = np.argsort(block, kind="stable")
            for i, j in _links(block[order], fp[left[order]], distance, depth + 1):
                yield left[order[i]], left[order[j]]
    left = np.repeat(np.where(sizes <= LONG_RUN, starts + sizes, 0), sizes)  # end of each row's run
    rows = np.arange(len(cell))
    for k in range(1, LONG_RUN):
        rows = rows[rows + k < left[rows]]
        if not len(rows):
            break
        hit = rows[np.bitwise_count(fp[rows] ^ fp[rows + k]) <= distance]
        if len(hit):
            yield hit, hit + k


def near_links(points: DataFrame, distance: int = 4, total: int = 0) -> DataFrame:
    """(a, b): links whose components are those of all pairs within ``distance``.

    Rows are dealt out by cell and sorted, so that a cell is a run; a run is kept
    until it ends, 16 bytes for each different fingerprint of the cell, or of
    one part of a heavy cell.
    """
    if distance > 4:
        raise ValueError("the grid of two halves and single steps finds distances up to 4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, kept = _Forest(), []

        def found(cell: np.ndarray, fp: np.ndarray, node: np.ndarray) -> pa.RecordBatch | None:
            a, b = [], []
            for i, j in _links(cell, fp.view(np.uint64), distance):
                for x, y in zip(node[i].tolist(), node[j].tolist(), strict=True):
                    if forest.join(x, y):
                        a.append(x)
                        b.append(y)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"]) if a else None

        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(x).to_numpy() for x in ("cell", "fp", "node")]
            if kept and kept[0][0][0] == now[0][-1]:  # all of the batch belongs to the open run
                kept.append(now)
                continue
            rows = [np.concatenate(x) for x in zip(*kept, now, strict=True)]
            cut = int(np.searchsorted(rows[0], rows[0][-1]))
            if cut and (out := found(*(x[:cut] for x in rows))):
                yield out
            kept = [[x[cut:] for x in rows]]
        if kept and (out := found(*(np.concatenate(x) for x in zip(*kept, strict=True)))):
            yield out

    return grid_rows(points, heavy_cells(points, total)).repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 4, distance: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document."""
    own = stored(fingerprints(docs, words, id_col, text_col), "fingerprints")
    points = stored(own.groupBy("fp").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("n")), "points")
    labels = connected_components(near_links(points.where("node IS NOT NULL").drop("n"), distance, points.count()))
    named = points.join(labels, "node", "left").select("fp", "n", F.coalesce("component", "node").alias("component_id"))
    return join_by_key(own, named, "fp", "n", own.count()).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, words: int = 4, distance: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents, as they were, without those whose component has a smaller id.

    Only ids that go are joined back, so Spark broadcasts them while they are
    few. Rows that repeat an id are one document, and one of them stays; they
    are looked for by id alone, and texts are moved only where there are any.
    Rows with a null id stay.
    """
    name = free_name(docs, "id_that_goes")
    gone = near_duplicates(docs, words, distance, id_col, text_col).where("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct()
    kept = docs.join(gone, docs[id_col] == F.col(name), "left_anti")
    again = stored(docs.select(F.col(id_col).alias(name)).groupBy(name).agg(F.count(F.lit(1)).alias(f"{name}_n")).where(f"{name}_n > 1 AND {name} IS NOT NULL").select(name), "repeated")
    if again.isEmpty():
        return kept
    return kept.join(again, kept[id_col] == F.col(name), "left_anti").unionByName(kept.join(again, kept[id_col] == F.col(name), "left_semi").dropDuplicates([id_col]))
