"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .skew import join_by_key
from .storage import drop, stored


def _star(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """One step: every node's larger (large) or smaller (small) neighbours point to its least neighbour.

    Nodes with very many neighbours meet theirs by broadcast.
    """
    if large:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count(F.lit(1)).alias("n"))
    joined = join_by_key(both, least, "a", "n", 2 * total if large else total)
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 50) -> DataFrame:
    """(node, component): for every node with an edge, the least node it can reach.

    Edges are undirected; loops, repeated edges and null ends are ignored. Rounds
    grow with the logarithm of the longest path, and each is written to the
    shared folder, so a lost executor costs one round at most. Nothing but two
    sums leaves the executors.
    """
    now = stored(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    digest = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = digest(now)
    for _ in range(most_rounds):
        if not before[0]:
            break
        last, now = now, stored(_star(_star(now, True, before[0]), False, before[0]), "edges")
        after = digest(now)
        drop(last.stored_at)  # a round needs the one before it, and no other
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    # at the fixed point every node other than the least one has a single edge, to the least one
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
