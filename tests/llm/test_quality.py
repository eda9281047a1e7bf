import math
import random
import re

import numpy as np
import xxhash

from quillspark.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_force(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    repeats = len(inside)
    failed = len(words) < 50 or 100 * repeats > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), repeats, failed


def texts():
    rng = random.Random(2)
    out = [None, "", " \n\t", "a b c", "x # é\n\nx # é\n \nx # é\x0b", "a b c a b c a b c d", "word\n" * 60]
    for _ in range(40):
        out.append("".join(rng.choice(["a", "bb", "é", "d|", "<e>"]) + rng.choice(" \n\t ") for _ in range(rng.randint(1, 150))))
    return out


def test_base_counts_equal_brute_force(spark):
    own = texts()
    docs = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string").selectExpr("*", "1 AS n_words", "text AS kept").repartition(3)
    model = quality.QualityModel.fit([], [])
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    for i, text in enumerate(own):
        r, expected = got[i], brute_force(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == expected
        assert r.kept == (not r.base_failed)  # without labels of both kinds


def test_repeated_words_with_many_kinds():
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 12, 300)
    wide = ids * (1 << 40)
    assert quality.repeated_words(ids) == quality.repeated_words(wide) == len({i + k for i in range(298) if sum((ids[i : i + 3] == ids[j : j + 3]).all() for j in range(298)) > 1 for k in range(3)})


def test_model_learns_and_keeps_clean_documents(spark):
    rng = random.Random(3)
    good = ["the", "of", "and", "reason", "people", "morning", "river", "light", "because", "under"]
    bad = ["win", "$$$", "click", "free", "|", "casino", "buy", "now!!!", "cheap", "xxx"]
    rows = []
    for i in range(600):
        label = int(i % 3 > 0)
        words = [rng.choice((good if rng.random() < 0.8 else bad) if label else (bad if rng.random() < 0.8 else good)) for _ in range(rng.randint(60, 200))]
        rows.append((i, " ".join(words), label))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 2] + [(5000, 1), (3, None), (None, 1), (7, 9)], "doc_id long, quality int")
    kept = {r.doc_id: r for r in quality.score(docs, quality.train(docs, labels)).collect()}
    unseen = [(i, y) for i, _, y in rows if not i % 2 and not kept[i].base_failed]
    assert np.mean([kept[i].kept == bool(y) for i, y in unseen]) > 0.97
    # calibrated: the mean probability is the share of good rows
    assert abs(np.mean([kept[i].quality for i, _ in unseen]) - np.mean([y for _, y in unseen])) < 0.08


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.score(docs, quality.train(docs, labels)).count() == 0


def bucket(h, group):
    mix, most = 0x9E3779B97F4A7C15, 2**64
    h = (h + group + 1) * mix % most
    return (h ^ h >> 29) * mix % most >> 64 - quality.TABLE_BITS


def plain_probability(model, text):
    """Feature by feature: words, character 3- to 5-grams of each word between spaces, word pairs."""
    words = WORD.findall(text)
    hashes = [xxhash.xxh64_intdigest(w.encode()) for w in words]
    grams = []
    for w in words:
        padded = f" {w} "
        for n in (3, 4, 5):
            for i in range(len(padded) - n + 1):
                h = 0
                for k, c in enumerate(padded[i : i + n]):
                    h = (h * 0x100000001B3 + ord(c)) % 2**64 if k else ord(c)
                grams.append(bucket(h, n))
    pairs = [bucket((a * 0x100000001B3 % 2**64) ^ (b + 0x9E3779B97F4A7C15) % 2**64, 2) for a, b in zip(hashes, hashes[1:], strict=False)]
    logit = model.bias + sum(sum(float(model.weights[i]) for i in own) / len(own) for own in ([bucket(h, 0) for h in hashes], grams, pairs) if own)
    return 1 / (1 + math.exp(-(model.slope * logit + model.offset)))


def test_probability_equals_a_sum_feature_by_feature(spark):
    rng = np.random.default_rng(4)
    model = quality.QualityModel(rng.normal(size=1 << quality.TABLE_BITS).astype(np.float32), 0.3, 1.7, -0.2)
    own = ["one", "Überall é 🤖 one two", "river light\nriver light", *(" ".join(rng.choice(["the", "of", "naïve", "$$", "ж"], 90)) for _ in range(6)), "long word " * 30_000]
    docs = spark.createDataFrame([*enumerate(own), (3, own[3]), (None, own[4])], "doc_id long, text string").repartition(3)
    got = quality.score(docs, model).collect()
    assert len(got) == len(own) + 2 and sum(r.doc_id == 3 for r in got) == 2
    for r in got:
        expected = plain_probability(model, own[4 if r.doc_id is None else r.doc_id])
        assert math.isclose(r.quality, expected, rel_tol=1e-6)
        assert r.kept == (not r.base_failed and expected >= quality.KEEP_PROBABILITY)


def test_fit_does_not_depend_on_how_texts_are_cut_into_blocks():
    rng = random.Random(1)
    own = [" ".join(rng.choice(["a", "bb", "ccc", "d|"] if i % 2 else ["x", "yy", "é"]) for _ in range(rng.randint(0, 40))).encode() for i in range(150)]
    blocks = [list(quality._feature_blocks(own, n)) for n in (7, 150)]
    w = np.random.default_rng(0).normal(size=1 << quality.TABLE_BITS)
    one, two = (np.concatenate([b.sums(w) for b in some]) for some in blocks)
    assert np.allclose(one, two) and len(one) == 150
    error = np.arange(150.0)
    assert np.allclose(*(sum(b.back(error[b.rows], len(w)) for b in some) for some in blocks))
    assert math.isclose(float(error @ one), float(sum(b.back(error[b.rows], len(w)) for b in blocks[1]) @ w), rel_tol=1e-9)
