"""Weighted co-occurrence graphs as edge tables (a < b, weight, documents).

A document with n distinct members gives every pair of them 1 / (n - 1). Pairs
are counted by n first and divided last, so equal fractions add up exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillspark.functions.rounding import half_even

from .relational import numbered


def distinct_members(rows: DataFrame, doc: str, member: str) -> DataFrame:
    """(doc, member, n): members of each document once, with their number."""
    own = rows.select(F.col(doc).alias("doc"), F.col(member).alias("member")).where("doc IS NOT NULL AND member IS NOT NULL").distinct()
    return own.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("doc")))


def weighted_pairs(rows: DataFrame, doc: str, member: str) -> DataFrame:
    """(a, b, weight, documents) of every pair of members that share a document.

    A document of n members is one array of a task and gives n (n - 1) / 2 rows
    there: fine for authors and institutions, some tens of seconds at 10,000
    members; documents of more are better left out or split before.
    """
    own = rows.select(F.col(doc).alias("doc"), F.col(member).alias("member")).where("doc IS NOT NULL AND member IS NOT NULL")
    # members of a document become one sorted array of different ones: one shuffle, and pairs need no join
    arrays = own.groupBy("doc").agg(F.sort_array(F.collect_set("member")).alias("members")).where(F.size("members") > 1)
    pairs = (
        arrays.select("members", F.size("members").alias("n"), F.posexplode("members").alias("at", "a"))
        .select("n", "a", F.explode(F.slice("members", F.col("at") + 2, F.col("n"))).alias("b"))
    )
    counted = pairs.groupBy("a", "b", "n").agg(F.count(F.lit(1)).alias("c"))
    return counted.groupBy("a", "b").agg(
        # terms in order of n, so the sum does not depend on how rows arrive
        F.aggregate(F.sort_array(F.collect_list(F.struct("n", "c"))), F.lit(0.0), lambda s, x: s + x["c"] / (x["n"] - 1)).alias("weight"),
        F.sum("c").alias("documents"),
    )


def strength(rows: DataFrame, doc: str, member: str) -> DataFrame:
    """(member, strength): documents with at least one partner; equals the sum of the member's weights."""
    return distinct_members(rows, doc, member).where("n > 1").groupBy("member").agg(F.count(F.lit(1)).alias("strength"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.withColumns({"a": F.col("b"), "b": F.col("a")}))


def degree(edges: DataFrame) -> DataFrame:
    """(node, degree, weight): partners and their summed weight."""
    return both_ways(edges.select("a", "b", "weight")).groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("weight"))


def neighbours(edges: DataFrame, node: Column) -> DataFrame:
    """Partners of a node, heaviest first, then by documents and id."""
    return both_ways(edges).where(F.col("a") == node).select(F.col("b").alias("node"), "weight", "documents").orderBy(F.desc("weight"), F.desc("documents"), "node")


def triangles(edges: DataFrame) -> DataFrame:
    """(node, triangles) by joining edges that share their smaller node."""
    e = edges.select("a", "b")
    open_ = e.alias("x").join(e.alias("y"), (F.col("x.a") == F.col("y.a")) & (F.col("x.b") < F.col("y.b"))).select(F.col("x.a").alias("p"), F.col("x.b").alias("q"), F.col("y.b").alias("r"))
    closed = open_.join(e, (F.col("q") == F.col("a")) & (F.col("r") == F.col("b")), "left_semi")
    return closed.select(F.explode(F.array("p", "q", "r")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("triangles"))


def metrics(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, density (6 places), mean degree (3), average clustering (4; degree below 2 counts 0)."""
    d = degree(edges).join(triangles(edges), "node", "left")
    possible = F.col("degree") * (F.col("degree") - 1) / 2
    return (
        d.agg(
            F.count(F.lit(1)).alias("nodes"),
            (F.sum("degree") / 2).cast("long").alias("edges"),
            F.avg("degree").alias("mean"),
            F.avg(F.when(F.col("degree") > 1, F.coalesce("triangles", F.lit(0)) / possible).otherwise(0.0)).alias("clustering"),
        )
        .select(
            "nodes",
            "edges",
            half_even(F.try_divide(2.0 * F.col("edges"), F.col("nodes") * (F.col("nodes") - 1)), 6).alias("density"),
            half_even(F.col("mean"), 3).alias("mean_degree"),
            half_even(F.col("clustering"), 4).alias("clustering"),
        )
    )


def modularity(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """One row: weighted modularity of a partition (node, community)."""
    g = groups.select(F.col("node"), F.col("community"))
    e = (
        edges.select("a", "b", "weight")
        .join(g.select(F.col("node").alias("a"), F.col("community").alias("ca")), "a")
        .join(g.select(F.col("node").alias("b"), F.col("community").alias("cb")), "b")
    )
    inside = e.groupBy(F.col("ca").alias("c")).agg(F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0.0)).alias("inside"), F.sum("weight").alias("half"))
    other = e.groupBy(F.col("cb").alias("c")).agg(F.sum("weight").alias("half"))
    per = inside.unionByName(other.withColumn("inside", F.lit(0.0))).groupBy("c").agg(F.sum("inside").alias("inside"), F.sum("half").alias("k"))
    total = e.agg(F.sum("weight").alias("m"))
    return per.crossJoin(total).agg(F.sum(F.col("inside") / F.col("m") - (F.col("k") / (2 * F.col("m"))) ** 2).alias("modularity"))


#: Nodes with more neighbours than this, and than a thousandth of all edges, meet theirs by a broadcast of under 1,000 rows.
HUB_EDGES = 10_000


def _to_least(edges: DataFrame, larger: bool, total: int) -> DataFrame:
    """One contraction of edges (a, b): larger, or smaller, neighbours of every node point to the least of its neighbourhood."""
    ends = both_ways(edges) if larger else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = ends.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"), F.count(F.lit(1)).alias("n"))
    most = max(HUB_EDGES, 2 * total // 1000)
    if 2 * total <= most:
        met = ends.join(least.drop("n"), "a")
    else:
        hubs = F.broadcast(least.where(F.col("n") > most).drop("n"))
        met = ends.join(hubs.select("a"), "a", "left_anti").join(least.where(F.col("n") <= most).drop("n"), "a").unionByName(ends.join(hubs, "a"))
    if larger:
        out = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def component_labels(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): the least node each node can reach, by contraction of edges into stars.

    A round points larger and then smaller neighbours to the least neighbour, so
    edges become fewer; rounds grow with the logarithm of the longest path. Each
    is checkpointed to the session's shared folder, so lost executors cost a
    round at most.
    """
    from quillspark.session import checkpointed

    own = edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL")
    nodes = own.select("a").unionByName(own.select(F.col("b").alias("a"))).distinct()
    now = checkpointed(own.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    print_of = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = print_of(now)
    for _ in range(most_rounds):
        if not before[0]:
            break
        now = checkpointed(_to_least(_to_least(now, True, before[0]), False, before[0]))
        after = print_of(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    # every node but the least of its component has one edge, to the least
    return nodes.join(now, "a", "left").select(F.col("a").alias("node"), F.coalesce("b", "a").alias("component"))


def component_summary(labels: DataFrame) -> DataFrame:
    """One row: components, nodes of the largest, and its share of all nodes."""
    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("components"), F.max("n").alias("largest"), (F.max("n") / F.sum("n")).alias("share"))


def bands(edges: DataFrame, slack: float = 1e-9) -> DataFrame:
    """Edges with a weight band: 1 up to 0.5, 2 up to 1, 3 up to 3, 4 beyond; 0 without a weight."""
    w = F.col("weight")
    return edges.withColumn("band", F.when(w.isNull(), 0).when(w <= 0.5 + slack, 1).when(w <= 1 + slack, 2).when(w <= 3 + slack, 3).otherwise(4))


def renumber(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Edges between the new names (old, new) of their ends; loops and unknown ends go, parallel edges add up."""
    n = names.select("old", "new")
    moved = (
        edges.join(n.select(F.col("old").alias("a"), F.col("new").alias("na")), "a")
        .join(n.select(F.col("old").alias("b"), F.col("new").alias("nb")), "b")
        .where("na <> nb")
        .select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b"), "weight", "documents")
    )
    return moved.groupBy("a", "b").agg(F.sum("weight").alias("weight"), F.sum("documents").alias("documents"))


def louvain(edges: DataFrame, resolution: float = 1.0, largest_driver_edges: int = 2_000_000) -> DataFrame:
    """(node, community): greedy modularity communities, numbered by falling size, then least node.

    A graph of communities is small by design and is partitioned on the driver,
    behind a check of its size; nodes are visited in order, so the result is
    the same every time.
    """
    spark = edges.sparkSession
    if (n := edges.count()) > largest_driver_edges:  # README states this exit
        raise ValueError(f"{n} edges are too many for the driver; restrict the graph to stronger edges first")
    graph: dict = {}
    for r in edges.select("a", "b", "weight").collect():
        graph.setdefault(r.a, {})[r.b] = graph.setdefault(r.b, {})[r.a] = float(r.weight)
    member = {v: v for v in graph}
    loops: dict = {}
    while graph:
        total = sum(sum(x.values()) for x in graph.values()) + 2 * sum(loops.values())
        if not total:
            break
        strength_of = {v: sum(x.values()) + 2 * loops.get(v, 0.0) for v, x in graph.items()}
        group = {v: v for v in graph}
        mass = dict(strength_of)
        moved, improved = True, False
        while moved:
            moved = False
            for v in sorted(graph):
                links: dict = {}
                for u, w in graph[v].items():
                    links[group[u]] = links.get(group[u], 0.0) + w
                own = group[v]
                mass[own] -= strength_of[v]
                gain = lambda c: links.get(c, 0.0) - resolution * strength_of[v] * mass[c] / total  # noqa: E731, B023
                best = max(sorted(links), key=gain, default=own)
                if gain(best) <= gain(own) + 1e-12:
                    best = own
                mass[best] += strength_of[v]
                if best != own:
                    group[v], moved, improved = best, True, True
        if not improved:
            break
        merged: dict = {}
        inner: dict = {}
        for v, x in graph.items():
            c = group[v]
            merged.setdefault(c, {})
            inner[c] = inner.get(c, 0.0) + loops.get(v, 0.0)
            for u, w in x.items():
                if group[u] == c:
                    inner[c] += w / 2
                else:
                    merged[c][group[u]] = merged[c].get(group[u], 0.0) + w
        member = {v: group[c] for v, c in member.items()}
        graph, loops = merged, inner
    groups: dict = {}
    for v, c in member.items():
        groups.setdefault(c, []).append(v)
    order = sorted(groups.values(), key=lambda g: (-len(g), min(g)))
    return spark.createDataFrame([(v, k) for k, g in enumerate(order) for v in sorted(g)], edges.select(F.col("a").alias("node")).schema.add("community", "integer"))


def numbered_communities(groups: DataFrame, least: int = 8, most: int = 40) -> DataFrame:
    """(node, community): 0.. by falling size, then least node, for groups of ``least`` or more, at most ``most``; else -1."""
    sizes = groups.groupBy("community").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first"))
    number = numbered(sizes.where(F.col("n") >= least), [F.desc("n"), F.col("first")], "number").where(F.col("number") < most)
    return groups.join(number.select("community", "number"), "community", "left").select("node", F.coalesce("number", F.lit(-1)).alias("community"))


def community_summary(groups: DataFrame, members: DataFrame, topics: DataFrame, labels: DataFrame, most: int = 3) -> DataFrame:
    """(community, n, documents, macro, topics, label): what each numbered community works on.

    ``members`` has (doc, node), ``topics`` (doc, topic, macro), ``labels`` (topic,
    label). Topics are the most frequent of the community's documents, of equal
    ones the least; the label joins the first two; the macro theme is the most
    frequent one.
    """
    own = groups.where("community >= 0")
    size = own.groupBy("community").agg(F.count(F.lit(1)).alias("n"))
    docs = own.join(members, "node").select("community", "doc").distinct()
    total = docs.groupBy("community").agg(F.count(F.lit(1)).alias("documents"))
    placed = docs.join(topics.where("topic >= 0"), "doc")
    ranked = lambda c: F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("k"), F.col(c).alias("v"))))
    per = placed.groupBy("community", "topic").agg(F.count(F.lit(1)).alias("k")).join(labels, "topic", "left")
    tops = per.groupBy("community").agg(F.transform(F.slice(ranked("topic"), 1, most), lambda x: x["v"]).alias("topics"), F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("k"), F.col("topic").alias("t"), F.col("label").alias("l")))).alias("_l"))
    macro = placed.where("macro IS NOT NULL").groupBy("community", "macro").agg(F.count(F.lit(1)).alias("k")).groupBy("community").agg(F.min(F.struct((-F.col("k")).alias("k"), F.col("macro").alias("m")))["m"].alias("macro"))
    label = F.array_join(F.transform(F.slice("_l", 1, 2), lambda x: x["l"]), " · ")
    none = F.array().cast("array<int>")
    return size.join(total, "community", "left").join(macro, "community", "left").join(tops, "community", "left").select("community", "n", F.coalesce("documents", F.lit(0)).alias("documents"), "macro", F.coalesce(F.col("topics").cast("array<int>"), none).alias("topics"), F.coalesce(F.nullif(label, F.lit("")), F.lit("no topic")).alias("label"))
