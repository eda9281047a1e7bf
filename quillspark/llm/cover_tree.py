"""Exact top-k inner products by dual cover trees over queries and data.

Every task holds one block of data vectors and one block of queries, indexes each
in a cover tree, and descends both trees together. For a query node with centre
c and radius r and a data node with centre d and radius s, no pair below them
scores more than ``<c, d> + r |d| + s |c| + r s``; the pair of nodes is dropped
once that is less than the worst k-th score among the node's queries. The bounds
of all children of two nodes are one matrix product.

Scores are exact integers. Where they fit 52 bits, doubles hold them exactly;
otherwise doubles, with a margin for their error, only say which pairs may
count, and those are summed in integers of any size. A score beyond 64 bits is
returned as the nearest 64-bit integer and ranked by its true value.

Defined cases: vectors that are null, empty, or hold a null or non-finite
component take no part, nor do those (of doubles) that ``scale`` takes beyond
1e150; vectors of different lengths have no inner product and do not meet; a
query's own row is no candidate, nor is any other row with its id; ties go to
the smaller id; rows that repeat an id are separate candidates, and one query,
of the shortest and then least vector; with fewer candidates than k all are
returned; other columns, whatever their names, are not looked at; an empty table
gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from .storage import filesystem, new_folder, stored

#: Points a node may hold before it is split into nodes of half the radius.
LEAF = 48
#: Query nodes are split further: small ones have tight bounds.
QUERY_LEAF = 16
#: Candidate centres whose distances to a node's points are one product.
CENTRES = 128
#: Children of a query node whose bounds are taken together.
FAMILY = 64
#: Doubles hold integers below this exactly.
EXACT = 2.0**52
LEAST, MOST = -(2**63), 2**63 - 1
#: Squares of larger components are no doubles; a float's are far smaller.
LARGEST = 1e150


class Node:
    __slots__ = ("_family", "centre", "children", "norm", "points", "radius")

    def __init__(self, centre: int, points: np.ndarray, radius: float, norm: float):
        self.centre, self.points, self.radius, self.norm = centre, points, radius, norm
        self.children: list[Node] = []
        self._family = None

    def family(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Centre vectors, radii and norms of the children, and which of them are leaves."""
        if self._family is None:
            self._family = _family(self.children, x)
        return self._family


def _family(nodes: list[Node], x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return x[[c.centre for c in nodes]], np.array([c.radius for c in nodes]), np.array([c.norm for c in nodes]), np.array([not c.children for c in nodes])


def cover_tree(x: np.ndarray, leaf: int = LEAF) -> Node | None:
    """Cover tree over the rows of x, built level by level.

    Invariants: a node's centre is one of its points and the centre of its first
    child; centres of one node's children are further apart than the child
    radius; a node's points lie within its radius of its centre (``radius`` is
    the distance of the furthest one). Nodes of few points, and of equal points,
    are leaves.
    """
    if not len(x):
        return None
    norms = np.einsum("ij,ij->i", x, x)
    # one product of a centre and 1 with a point and minus half its square: half of |c|^2 less the squared distance
    points_and, centres_and = np.column_stack((x, norms / -2.0)), np.column_stack((x, np.ones(len(x))))
    margin = 1e-12 * float(norms.max())

    def away(centre: np.ndarray, product: np.ndarray, points: np.ndarray) -> np.ndarray:
        """Distances, rounded up, as differences of large squares lose digits."""
        return np.sqrt(np.maximum(norms[centre] - 2.0 * product, 0.0) + 1e-12 * (norms[centre] + norms[points]))

    points = np.arange(len(x))
    far = away(points[:1], points_and @ centres_and[0], points)
    root = Node(0, points, float(far.max()), float(np.sqrt(norms[0])))
    open_nodes = [(root, far)]
    while open_nodes:
        node, far = open_nodes.pop()
        reach = node.radius / 2.0
        if len(node.points) <= leaf or far.max() <= 2e-6 * node.norm:
            continue
        left, centre = node.points, node.centre
        own = far <= reach
        own[left == centre] = True
        groups = [(centre, left[own], far[own])]
        left = left[~own]
        while len(left):
            # the first points left are candidates; those within reach of an earlier one are no centres
            some = left[:CENTRES]
            product = centres_and[some] @ points_and[left].T
            covers = product >= ((norms[some] - reach * reach) / 2.0 - margin)[:, None]
            chosen: list[int] = []
            for i in range(len(some)):
                if not chosen or not covers[chosen, i].any():
                    chosen.append(i)
            covers = covers[chosen]
            covers[np.arange(len(chosen)), chosen] = True
            at = np.flatnonzero(covers.any(axis=0))
            first = covers[:, at].argmax(axis=0)
            order = np.argsort(first, kind="stable")
            at, cuts = at[order], np.searchsorted(first[order], np.arange(len(chosen) + 1))
            for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                centre, own = int(some[chosen[k]]), left[at[a:b]]
                groups.append((centre, own, away(centre, product[chosen[k], at[a:b]], own)))
            left = np.delete(left, at)
        for centre, own, distance in groups:
            child = Node(centre, own, float(distance.max()), float(np.sqrt(norms[centre])))
            node.children.append(child)
            if len(own) > leaf:
                open_nodes.append((child, distance))
    return root


class DualSearch:
    """Best k data rows for each query row, by descent of both trees."""

    def __init__(self, queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, data_ids: np.ndarray, k: int):
        self.q, self.qi, self.x, self.xi, self.k = queries, query_ids, data, data_ids, k
        n = len(queries)
        self.scores = np.full((n, k), -np.inf)
        self.ids = np.full((n, k), np.iinfo(np.int64).max)
        self.worst = np.full(n, -np.inf)
        self.compared = 0
        top = max((float(np.abs(y).max(initial=0.0)) for y in (queries, data)), default=0.0)
        self.wide = top * top * queries.shape[1] >= EXACT if n else False
        self.best: list[list[tuple[int, int]]] = [[] for _ in range(n)]  # (-score, id), if wide

    def run(self, x: Node | None = None) -> None:
        q, x = cover_tree(self.q, QUERY_LEAF), x or cover_tree(self.x)
        if q is None or x is None:
            return
        stack = [(np.inf, q, x)]
        while stack:
            bound, a, b = stack.pop()
            if bound < self.worst[a.points].min():
                continue
            if not a.children and not b.children:
                self._compare(a.points, b.points)
                continue
            queries, data = a.children or [a], b.children or [b]
            if a.children and b.children and a.radius < b.radius / 4.0:  # the queries are close together already
                queries = [a]
            family = b.family(self.x) if b.children else _family(data, self.x)
            for at in range(0, len(queries), FAMILY):
                some = queries[at : at + FAMILY]
                for c, bounds in zip(some, self._bounds(some, *family[:3]), strict=True):
                    stack += self._meet(c, data, bounds, family[3])

    def _meet(self, a: Node, data: list[Node], bounds: np.ndarray, leaf: np.ndarray) -> list[tuple[float, Node, Node]]:
        """Compare a leaf with the leaves among ``data``, most promising first; pairs left to descend, best last."""
        if not a.children:
            open_leaves, step = np.flatnonzero(leaf), 4 * self.k
            while len(open_leaves):
                open_leaves = open_leaves[bounds[open_leaves] >= self.worst[a.points].min()]
                if len(open_leaves) > step:
                    order = np.argpartition(-bounds[open_leaves], step)
                    some, open_leaves = open_leaves[order[:step]], open_leaves[order[step:]]
                else:
                    some, open_leaves = open_leaves, open_leaves[:0]
                if len(some):
                    self._compare(a.points, np.concatenate([data[i].points for i in some.tolist()]))
                step *= 4
            bounds = np.where(leaf, -np.inf, bounds)
        order = np.flatnonzero((bounds >= self.worst[a.points].min()) & (bounds > -np.inf))
        order = order[np.argsort(bounds[order], kind="stable")]
        return [(float(bounds[i]), a, data[i]) for i in order.tolist()]

    def _bounds(self, some: list[Node], centres: np.ndarray, radius: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """(some, centres): no pair below two nodes scores more; with a margin for rounding."""
        own, reach, size = self.q[[c.centre for c in some]], np.array([c.radius for c in some])[:, None], np.array([c.norm for c in some])[:, None]
        bounds = own @ centres.T + reach * norm + radius * size + reach * radius
        return bounds + 1e-9 * (size + reach) * (norm + radius) + 1e-6

    def _compare(self, rows: np.ndarray, columns: np.ndarray) -> None:
        """Exact scores of a block, merged into the best so far; ties to smaller ids."""
        self.compared += len(rows) * len(columns)
        scores = self.q[rows] @ self.x[columns].T
        scores[self.qi[rows][:, None] == self.xi[columns][None, :]] = -np.inf
        if self.wide:
            self._compare_wide(rows, columns, scores)
            return
        hit = np.flatnonzero((scores >= self.worst[rows][:, None]).any(axis=1))
        if not len(hit):
            return
        rows, scores = rows[hit], scores[hit]
        every = np.concatenate((self.scores[rows], scores), axis=1)
        ids = np.concatenate((self.ids[rows], np.broadcast_to(self.xi[columns], scores.shape)), axis=1)
        order = np.lexsort((ids, -every), axis=1)[:, : self.k]
        self.scores[rows] = np.take_along_axis(every, order, axis=1)
        self.ids[rows] = np.take_along_axis(ids, order, axis=1)
        self.worst[rows] = np.maximum(self.worst[rows], self.scores[rows, -1])

    def _compare_wide(self, rows: np.ndarray, columns: np.ndarray, about: np.ndarray) -> None:
        """Pairs that may count, by approximate scores and their margin, summed in integers of any size."""
        norms = np.sqrt(np.einsum("ij,ij->i", self.x[columns], self.x[columns]))
        for row, scores in zip(rows.tolist(), about, strict=True):
            margin = 1e-12 * norms * float(np.sqrt(self.q[row] @ self.q[row]))
            hit = np.flatnonzero((scores + margin >= self.worst[row]) & (scores > -np.inf))
            if not len(hit):
                continue
            q = [int(c) for c in self.q[row].tolist()]
            found = [(-sum(a * int(b) for a, b in zip(q, self.x[columns[j]].tolist(), strict=True)), int(self.xi[columns[j]])) for j in hit.tolist()]
            self.best[row] = sorted(self.best[row] + found)[: self.k]
            if len(self.best[row]) == self.k:
                worst = float(-self.best[row][-1][0])
                self.worst[row] = max(self.worst[row], worst - 1e-12 * abs(worst))

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes | None]]:
        """(query row, id, score, true score in sortable bytes where it does not fit 64 bits)."""
        if not self.wide:
            row, column = np.nonzero(np.isfinite(self.scores))
            return row, self.ids[row, column], self.scores[row, column].astype(np.int64), [None] * len(row)
        flat = [(row, i, -s) for row, own in enumerate(self.best) for s, i in own]
        wide = [(s + (1 << 2303)).to_bytes(288, "big") if not LEAST < s < MOST else None for _, _, s in flat]
        return np.array([r for r, _, _ in flat], dtype=np.int64), np.array([i for _, i, _ in flat], dtype=np.int64), np.array([min(max(s, LEAST), MOST) for _, _, s in flat], dtype=np.int64), wide


def integer_vectors(vectors: DataFrame, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component; unusable vectors are left out."""
    x = F.col("v0")
    good = F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c * F.lit(float(scale))) > LARGEST))
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v0"))
    whole = lambda c: F.when(F.abs(c) < EXACT, F.floor(c).cast("double")).otherwise(c)  # noqa: E731  larger doubles are whole numbers
    return own.where(good).select("vec_id", F.transform(x, lambda c: whole(c * F.lit(float(scale)))).alias("v"))


#: Queries in one file, and data vectors of one tree: 520 bytes each at 64 components.
QUERY_BLOCK, DATA_BLOCK = 20_000, 50_000


def _by_length(batches: list[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of the vectors of each length."""
    ids = np.concatenate([b.column("vec_id").to_numpy() for b in batches])
    flat = np.concatenate([np.asarray(b.column("v").flatten()) for b in batches])
    sizes = np.concatenate([np.asarray(pc.list_value_length(b.column("v"))) for b in batches]).astype(np.int64)
    kinds = np.unique(sizes).tolist()
    starts = np.cumsum(sizes) - sizes
    for n in kinds:
        own = np.flatnonzero(sizes == n)
        yield ids[own], flat.reshape(-1, n) if len(kinds) == 1 else flat[starts[own][:, None] + np.arange(n)]


def _write_blocks(queries: DataFrame, folder: str, blocks: int) -> list[str]:
    """Query blocks as Arrow files in the shared folder; a block is one hash partition."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        kept = [b for b in batches if b.num_rows]
        if not kept:
            return
        system, where = filesystem(folder)
        name = f"{TaskContext.get().partitionId():06d}.arrow"
        part = f"{where}/.{name}.{uuid.uuid4().hex}"
        with system.open_output_stream(part, compression=None) as out, pa.ipc.new_file(out, kept[0].schema) as file:
            for b in kept:
                file.write(b)
        system.move(part, f"{where}/{name}")  # a repeated attempt replaces the file by an equal one
        yield pa.RecordBatch.from_pydict({"name": [name]})

    system, where = filesystem(folder)
    system.create_dir(where)
    return sorted(r.name for r in queries.repartition(blocks, "vec_id").sortWithinPartitions("vec_id").mapInArrow(write, "name string").collect())


def _read_block(folder: str, name: str) -> list[tuple[np.ndarray, np.ndarray]]:
    system, where = filesystem(folder)
    with system.open_input_file(f"{where}/{name}") as f:
        return list(_by_length(pa.ipc.open_file(f).read_all().to_batches()))


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each id divisible by ``every``, its best others.

    Queries are written to the shared folder in blocks of bounded size. A task
    indexes its data vectors, one tree for so many of them, and takes the query
    blocks one after the other, so neither side has to fit into memory and the
    data are read once. Each tree gives k rows a query at most; they are merged
    by query in two steps, so no task receives more than a share of one query's.
    """
    data = stored(integer_vectors(vectors, scale, id_col, vector_col), "vectors")
    queries = data.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min_by("v", F.struct(F.size("v"), "v")).alias("v"))
    folder = new_folder(vectors.sparkSession, "queries")
    names = _write_blocks(queries, folder, max(1, -(-queries.count() // QUERY_BLOCK)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def some(kept: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, x in _by_length(kept):
                tree = cover_tree(x)
                for name in names:
                    for query_ids, q in _read_block(folder, name):
                        if q.shape[1] != x.shape[1]:
                            continue
                        run = DualSearch(q, query_ids, x, ids, k)
                        run.run(tree)
                        row, found, scores, wide = run.found()
                        yield pa.RecordBatch.from_arrays([pa.array(query_ids[row]), pa.array(found), pa.array(scores), pa.array(wide, pa.binary())], names=["query_id", "vec_id", "score", "wide"])

        kept, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            kept.append(batch)
            size += batch.num_rows
            if size >= DATA_BLOCK:
                yield from some(kept)
                kept, size = [], 0
        if size:
            yield from some(kept)

    order = [F.col("score").desc(), F.col("wide").desc(), F.col("vec_id")]
    found = data.mapInArrow(search, "query_id long, vec_id long, score long, wide binary").withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(8)))
    for keys in (["query_id", "salt"], ["query_id"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
