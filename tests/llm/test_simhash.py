import random
import time

import numpy as np
import pytest
import xxhash

from quillspark.llm import simhash, skew
from quillspark.llm.components import connected_components


def brute_fingerprint(text, words=4):
    own = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in (text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not own:
        return 0
    shingles = [" ".join(own[i : i + words]) for i in range(max(1, len(own) - words + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, distance=4):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    rows = list(zip(ids, fps, strict=True))
    for n, (a, x) in enumerate(rows):
        for b, y in rows[:n]:
            if (x ^ y).bit_count() <= distance:
                p, q = sorted((root(a), root(b)))
                up[q] = p
    return {i: root(i) for i in ids}


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [None, "", "  \n", "one", "One two Three", "ÀÉ one two THREE four"]
    for _ in range(60):
        own = [rng.choice(vocabulary) for _ in range(rng.choice([5, 80, 300]))]
        texts += [" ".join(own)] * rng.choice([1, 1, 3])
        for _ in range(rng.choice([0, 0, 4])):
            own[rng.randrange(len(own))] = rng.choice(vocabulary)
            texts.append("\t".join(own))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "doc_id AS fp", "'x' AS cell").repartition(5)
    got = {r.doc_id: r for r in simhash.near_duplicates(df).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{x:016x}" for x in fps]
    expected = brute_components(range(len(texts)), fps)
    assert {i: r.component_id for i, r in got.items()} == expected
    assert len(set(expected.values())) < len({*fps})


def test_empty_and_repeated_rows(spark):
    schema = "doc_id long, text string"
    assert simhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = simhash.near_duplicates(spark.createDataFrame([(5, "a b"), (5, "a b"), (3, "a b"), (None, "a b")], schema)).collect()
    assert [r.component_id for r in rows] == [3] * 4


@pytest.mark.parametrize("seed", range(4))
def test_links_keep_components_of_a_dense_cell(seed):
    """Leaders and offsets connect the same points as all pairs do."""
    rng = np.random.default_rng(seed)
    centre = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    fp = [int(rng.choice(centre)) for _ in range(400)]
    for i in range(len(fp)):
        for b in rng.integers(0, 40, rng.integers(0, 6)):
            fp[i] ^= 1 << int(b)
    fp = np.array(sorted({*fp}), dtype=np.uint64)
    expected = brute_components(range(len(fp)), fp.tolist())
    for long_run in (2, 10**6):
        simhash.LONG_RUN, kept = long_run, simhash.LONG_RUN
        try:
            forest = simhash._Forest()
            for i, j in simhash._links(np.zeros(len(fp), dtype=np.int64), fp, 4):
                for x, y in zip(i.tolist(), j.tolist(), strict=True):
                    assert (int(fp[x]) ^ int(fp[y])).bit_count() <= 4
                    forest.join(x, y)
        finally:
            simhash.LONG_RUN = kept
        assert {i: forest.root(i) for i in range(len(fp))} == expected


def test_grid_meets_every_pair_within_four_bits():
    rng = np.random.default_rng(3)
    a = rng.integers(-(2**63), 2**63, 3000, dtype=np.int64)
    b = a.copy()
    for _ in range(4):
        b ^= np.int64(1) << rng.integers(0, 64, len(a))
    cells = []
    for fp in (a, b):
        own = [set() for _ in fp]
        for half in (0, 1):
            for row, cell in zip(*simhash._cells((fp >> (32 * half)) & 0xFFFFFFFF), strict=True):
                own[row].add((half, int(cell)))
        cells.append(own)
    assert all(x & y for x, y in zip(*cells, strict=True))


def test_components_of_a_long_path(spark):
    path = list(range(200))
    random.Random(0).shuffle(path)
    edges = [(a, b) for a, b in zip(path, path[1:], strict=False)] + [(1000, 1001), (1001, 1000), (7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(200)} | {1000: 1000, 1001: 1000}


def test_far_points_of_one_cell_take_no_quadratic_time():
    """100,000 points of one own cell, nearly all far apart: a leader a point would take minutes."""
    rng = np.random.default_rng(5)
    n = 100_000
    low = np.zeros(n, dtype=np.uint64)
    for at in range(0, 32, 2):  # each segment has one bit of two, so all have the same counts
        low |= np.uint64(1) << (rng.integers(0, 2, n).astype(np.uint64) + np.uint64(at))
    fp = np.unique(low | rng.integers(0, 1 << 32, n, dtype=np.uint64) << np.uint64(32))
    near = fp[:50] ^ np.uint64(0b11 << 40)  # planted: two bits of the other half differ
    fp = np.unique(np.concatenate((fp, near)))
    began = time.perf_counter()
    links = [(int(a), int(b)) for i, j in simhash._links(np.zeros(len(fp), dtype=np.int64), fp, 4) for a, b in zip(i, j, strict=True)]
    assert time.perf_counter() - began < 40
    assert all((int(fp[a]) ^ int(fp[b])).bit_count() <= 4 for a, b in links)
    found = {frozenset((int(fp[a]), int(fp[b]))) for a, b in links}
    assert all(frozenset((int(x), int(x) ^ (0b11 << 40))) in found for x in fp[np.isin(fp, near)])


def test_heavy_cells_and_frequent_fingerprints(spark, monkeypatch):
    """The same components when every cell is heavy, and when a third of the rows share one fingerprint."""
    rng = random.Random(7)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.choice([3, 60]))) for _ in range(150)]
    texts += [t + " a" for t in texts[:50]] + [None] * 100
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    expected = {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()}
    assert expected == brute_components(range(len(texts)), [brute_fingerprint(t) for t in texts])
    monkeypatch.setattr(simhash, "HEAVY_CELL", 0)
    monkeypatch.setattr(skew, "FREQUENT_ROWS", 4)
    points = spark.createDataFrame([(5, 1), (-7, 2)], "fp long, node long")
    assert len(simhash.heavy_cells(points, 10)) > 60 and len(simhash.heavy_cells(points, 0)) == 0
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()} == expected


def test_names_of_other_columns_do_not_matter(spark):
    rows = [(1, "a b c d e", 1, 2), (2, "a b c d e", 3, 4), (2, "a b c d e", 3, 4), (3, "x y", 5, 6), (3, "x y", 7, 8), (None, "q", 9, 9), (None, "q", 9, 9)]
    for names in ("gone_id", "again_id"), ("component_id", "fp"), ("id_that_goes", "ID_THAT_GOES_"), ("node", "n"), ("a", "b"):
        df = spark.createDataFrame(rows, f"doc_id long, text string, {names[0]} long, {names[1]} long")
        kept = simhash.one_of_each(df)
        assert kept.columns == df.columns
        assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 1, 3]


def test_very_long_text(spark):
    text = "Alpha beta GAMMA delta epsilon " * 40_000
    [row] = simhash.near_duplicates(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert row.fingerprint == f"{brute_fingerprint(text):016x}"
