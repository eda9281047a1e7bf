import math
import random

import numpy as np
import pytest

from quillspark.llm import cover_tree


def nodes(node):
    yield node
    for c in node.children:
        yield from nodes(c)


@pytest.mark.parametrize("seed", range(5))
def test_tree_invariants(seed):
    rng = np.random.default_rng(seed)
    x = np.floor(rng.normal(size=(400, 5)) * 100 + 500 * rng.integers(0, 3, (400, 1)))
    tree = cover_tree.cover_tree(x, leaf=4)
    for node in nodes(tree):
        assert np.linalg.norm(x[node.points] - x[node.centre], axis=1).max() <= node.radius + 1e-6
        if node.children:
            assert node.children[0].centre == node.centre
            assert sorted(np.concatenate([c.points for c in node.children])) == sorted(node.points)
            centres = x[[c.centre for c in node.children]]
            apart = np.linalg.norm(centres[:, None] - centres[None], axis=2)
            assert apart[~np.eye(len(centres), dtype=bool)].min(initial=math.inf) > node.radius / 2


def brute_force(rows, k, every):
    own = [(i, [math.floor(1024 * float(np.float32(c))) for c in v]) for i, v in rows if v and i is not None and all(c is not None and math.isfinite(c) for c in v)]
    n = max({len(v) for _, v in own}, key=[len(v) for _, v in own].count)
    own = [(i, v) for i, v in own if len(v) == n]
    out = []
    for i, v in own:
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in own if j != i)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("block", [30, 50_000])
def test_top_k_equals_brute_force(spark, monkeypatch, block):
    rng = random.Random(6)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(3)]
    rows = [(i, [c + rng.gauss(0, 0.2) for c in rng.choice(centres)]) for i in range(300)]
    rows += [(1000 + i, rows[40][1]) for i in range(30)]  # ties, many copies of one vector
    rows += [(2000, None), (2010, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2020, [math.nan] * 6), (2030, [math.inf] * 6), (2040, [1.0]), (2050, []), (None, [1.0] * 6)]
    monkeypatch.setattr(cover_tree, "DATA_BLOCK", block)
    monkeypatch.setattr(cover_tree, "QUERY_BLOCK", 7)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "vec_id AS score", "1 AS rank").repartition(3)
    got = sorted(tuple(r) for r in cover_tree.top_k(df, k=10, every=10).collect())
    assert got == brute_force(rows, 10, 10)


def test_fewer_candidates_than_k_and_empty(spark):
    schema = "vec_id long, embedding array<float>"
    got = cover_tree.top_k(spark.createDataFrame([(0, [1.0]), (1, [2.0])], schema)).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 2 * 1024 * 1024)]
    assert cover_tree.top_k(spark.createDataFrame([], schema)).count() == 0


def test_search_prunes(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(20, 8)) * 40_000
    x = np.floor(centres[rng.integers(0, 20, 4000)] + rng.normal(size=(4000, 8)) * 500)
    run = cover_tree.DualSearch(x[:100], np.arange(100), x, np.arange(4000), 10)
    run.run()
    assert run.compared < 0.5 * 100 * 4000
    scores = x[:100] @ x.T
    scores[np.arange(100), np.arange(100)] = -np.inf
    assert np.array_equal(np.sort(scores, axis=1)[:, :-11:-1], run.scores)


def test_large_components_are_ranked_exactly(spark):
    """Scores beyond 52 and beyond 64 bits, told apart by their last digits."""
    rng = random.Random(2)
    big = [[float(np.float32(rng.choice([1e6, 3e9, -2e17, 1e30]) * rng.random())) for _ in range(4)] for _ in range(60)]
    rows = list(enumerate(big)) + [(100 + i, [4e9 + 4096 * i, 4e9, 0.0, 1.0]) for i in range(20)] + [(200 + i, [3e38, 1.0, float(i), 0.0]) for i in range(15)] + [(300, [0.5] * 4)]
    rows += [(400 + i, [1e6 + i / 8, 1e6, -3.0]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = sorted(tuple(r) for r in cover_tree.top_k(df, k=5, every=5).collect())
    expected = [(q, r, v, min(max(s, -(2**63)), 2**63 - 1)) for n in (3, 4) for q, r, v, s in brute_force([x for x in rows if len(x[1]) == n], 5, 5)]
    assert got == sorted(expected)
    assert any(s == 2**63 - 1 for *_, s in got) and any(2**53 < s < 2**63 - 1 for *_, s in got)


def test_vectors_meet_those_of_their_length(spark):
    rows = [(0, [1.0, 2.0]), (1, [3.0, 1.0]), (2, [5.0]), (4, [7.0]), (10, [1.0, 1.0, 1.0])]
    got = sorted(tuple(r) for r in cover_tree.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), every=2).collect())
    m = 1024 * 1024
    assert got == [(0, 1, 1, 5 * m), (2, 1, 4, 35 * m), (4, 1, 2, 35 * m)]


def test_pruning_on_the_embeddings():
    """How many pairs are compared on real rows; unit vectors of 64 components leave little to prune."""
    import duckdb

    rows = duckdb.sql("SELECT vec_id, embedding FROM '/root/testdata/sf0.1/embeddings.parquet' ORDER BY vec_id").fetchall()
    x = np.floor(1024 * np.array([v for _, v in rows], dtype=np.float64))
    ids = np.array([i for i, _ in rows])
    own = ids % 100 == 0
    run = cover_tree.DualSearch(x[own], ids[own], x, ids, 10)
    run.run()
    scores = x[own] @ x.T
    scores[ids[own][:, None] == ids[None, :]] = -np.inf
    assert np.array_equal(np.sort(scores, axis=1)[:, :-11:-1], run.scores)
    print("compared", run.compared / scores.size)
    assert run.compared < 0.9 * scores.size
