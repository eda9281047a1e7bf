from quillspark.operators import topics as T


def test_topics_across_runs(spark):
    before = spark.createDataFrame([(f"d{i}", i // 10) for i in range(40)] + [("gone", 0)], "doc string, topic int")
    now = spark.createDataFrame([(f"d{i}", 2 - i // 10) for i in range(30)] + [(f"n{i}", 7) for i in range(5)] + [(f"m{i}", 8) for i in range(9)], "doc string, topic int")
    matches = T.match_topics(before, now)
    assert {(r.topic, r.old) for r in matches.collect()} == {(2, 0), (1, 1), (0, 2)}
    assert {(r.group, r.id) for r in T.number_topics(now, matches, 4).collect()} == {(2, 0), (1, 1), (0, 2), (8, 4), (7, 5)}
    topics = now.select("topic").distinct()
    old = spark.createDataFrame([(0, 10), (1, 10), (2, 20), (3, 30)], "old int, macro int")
    centres = spark.createDataFrame([(2, [1.0, 0.0]), (1, [0.9, 0.1]), (0, [0.0, 2.0]), (7, [0.1, 1.0]), (8, [3.0, 0.1])], "topic int, centre array<double>")
    clustered = topics.selectExpr("topic", "CAST(topic % 2 AS INT) AS macro")
    assert {r.topic: r.macro for r in T.persistent_macros(topics, matches, old, centres, clustered).collect()} == {2: 10, 1: 10, 0: 20, 7: 20, 8: 10}
    assert {r.topic: r.macro for r in T.persistent_macros(topics, matches.where("topic = 2"), old, centres, clustered).collect()} == {0: 0, 1: 1, 2: 0, 7: 1, 8: 0}
    words = lambda rows: spark.createDataFrame([(t, w, i + 1) for t, ws in rows for i, w in enumerate(ws.split())], "topic int, term string, rank int")
    labels = spark.createDataFrame([(0, "Zero"), (1, "One"), (2, "Two")], "old int, label string")
    got = T.reusable_labels(matches, words([(0, "a b c d"), (1, "a b c d"), (2, "q r")]), words([(2, "a b c x"), (1, "a x y z"), (0, "s t")]), labels)
    assert {r.topic: r.label for r in got.collect()} == {2: "Zero"}


def test_embeddings_are_made_once(spark, tmp_path):
    def make(texts):
        import uuid

        (tmp_path / f"call-{uuid.uuid4().hex}-{len(texts)}").touch()
        return [[float(len(t)), 1.0] for t in texts]

    made = lambda: sum(int(p.name.rsplit("-", 1)[1]) for p in tmp_path.glob("call-*"))
    texts = spark.createDataFrame([("a", "one"), ("b", "three"), ("c", None)], "id string, text string").coalesce(1)
    cache = f"{tmp_path}/cache.parquet"
    assert {r.id: r.vector[0] for r in T.embed(texts, cache, make, "m").collect()} == {"a": 3.0, "b": 5.0} and made() == 2
    changed = spark.createDataFrame([("a", "one"), ("b", "seventeen")], "id string, text string")
    assert {r.id: r.vector[0] for r in T.embed(changed, cache, make, "m").collect()} == {"a": 3.0, "b": 9.0} and made() == 3
    T.embed(changed, cache, make, "other")
    assert made() == 5


def brute_leaves(weights, n, least):
    """Cut all links from the longest on; a set that falls into two large ones at a link has two clusters inside."""

    def parts(points, bound):
        left, out = set(points), []
        while left:
            group, stack = set(), [left.pop()]
            while stack:
                x = stack.pop()
                group.add(x)
                near = {y for y in left if weights.get((min(x, y), max(x, y)), float("inf")) < bound}
                left -= near
                stack += near
            out.append(frozenset(group))
        return out

    def inside(points):
        """The clusters that hold no other, in a set that is one; empty if it never falls into two."""
        own = points
        for bound in sorted({w for (x, y), w in weights.items() if x in points and y in points}, reverse=True):
            large = [g for g in parts(own, bound) if len(g) >= least]
            if len(large) > 1:
                return [c for g in large for c in (inside(g) or [g])]
            if not large:
                return []
            own = large[0]
        return []

    whole = parts(range(n), float("inf"))
    large = [g for g in whole if len(g) >= least]
    return [c for g in large for c in (inside(g) or ([g] if len(large) > 1 else []))] if len(whole) > 1 else inside(whole[0])


def test_density_hierarchy(spark):
    import math
    import random

    from quillspark.operators import vectors

    rng = random.Random(4)
    centres = [(1.0, 0.0, 0.0), (0.95, 0.3, 0.0), (0.0, 1.0, 0.1), (0.0, 0.1, 1.0)]
    own = [(i, [x + rng.gauss(0, 0.04) for x in rng.choice(centres)]) for i in range(90)] + [(200 + i, [rng.gauss(0, 1) for _ in range(3)]) for i in range(8)]
    df = spark.createDataFrame(own, "id int, v array<double>")
    near = vectors.nearest(df, df, "id", "v", len(own) - 1)
    got = {r.id: r.label for r in vectors.density_hierarchy(near, df, "id", 8, 5).collect()}
    ids = [i for i, _ in own]
    place = {x: i for i, x in enumerate(sorted(ids))}
    d, core = {}, {}
    for r in near.collect():
        d[place[r.query], place[r.neighbour]] = math.sqrt(max(0.0, 2 - 2 * r.similarity))
    for i in range(len(ids)):
        core[i] = sorted(v for (x, _), v in d.items() if x == i)[3]
    weights = {(a, b): max(v, core[a], core[b]) for (a, b), v in d.items() if a < b}
    expected = sorted(brute_leaves(weights, len(ids), 8), key=lambda g: (-len(g), min(g)))
    assert [{place[i] for i, k in got.items() if k == n} for n in range(len(expected))] == [set(g) for g in expected]
    assert len(expected) >= 3 and {k for k in got.values()} == {-1, *range(len(expected))}
    assert [vectors.automatic_size(n) for n in (100, 4265)] == [10, 21]
    few = vectors.density_hierarchy(near, df, "id", 90, 5).collect()
    assert {r.label for r in few} == {-1}
