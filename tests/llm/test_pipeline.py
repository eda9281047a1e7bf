import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from quillspark.llm import simhash  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(8)
    words = {"en": [f"{a}{b}" for a in ("the", "riv", "lig", "mor") for b in ("er", "ht", "ning", "on", "ly")], "de": [f"{a}{b}" for a in ("der", "flu", "mor", "übe") for b in ("ss", "gen", "ung", "ich", "keit")]}
    rows, labels = [], []
    for i in range(160):
        lang, bad = rng.choice(["en", "de"]), i % 4 == 0
        own = [rng.choice(["$$$", "|", "win!!!"] if bad and rng.random() < 0.7 else words[lang]) for _ in range(rng.randint(120, 200))]
        rows.append((i, " ".join(own), lang, "s", 1))
        labels.append((i, int(not bad), 0))
    rows += [(200 + i, rows[i][1] + " end", "en", "s", 1) for i in range(1, 40)]  # near copies
    rows += [rows[1], (300, None, None, None, None), (301, "", "en", "s", 1), (302, "12 34", "en", "s", 1), (303, "short text", "en", "s", 1)]
    return rows, labels


def test_stages_take_effect_and_keep_columns(spark, tmp_path):
    rows, labels = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), [len(rows)]
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if k < 3:
            assert docs.columns == columns
            assert docs.exceptAll(before).count() == 0
            seen.append(docs.count())
        if name == "language_id":
            assert {r.doc_id for r in before.collect()} - {r.doc_id for r in docs.collect()} == {300, 301, 302}
        if name == "quality_rules":
            ids = {r.doc_id for r in docs.collect()}
            assert 303 not in ids and len([i for i in ids if i < 160 and i % 4 == 0]) <= 2 and len([i for i in ids if i < 160 and i % 4]) >= 118
        if name == "simhash_near_dedup":
            components = {r.component_id for r in simhash.near_duplicates(before).collect()}
            assert sorted(r.doc_id for r in docs.collect()) == sorted(components)
    assert seen == sorted(seen, reverse=True)
    rerun = corpus_pipeline.run(spark, str(tmp_path))
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, rerun.select(key).collect())) == sorted(map(tuple, docs.select(key).collect()))


def test_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


CLASHING = ["gone_id", "again_id", "id_that_goes", "component_id", "fp", "node", "n", "a", "b", "lang_pred", "score", "held_out", "kept", "quality", "label", "n_words", "piece", "start", "length", "part", "local", "rank", "sequence_id", "offset", "ids"]


def test_columns_with_clashing_names(spark, tmp_path):
    """Each stage keeps the rows it keeps without them, and all but the last give them back as they were."""
    rows, labels = corpus()
    plain = spark.createDataFrame(rows, SCHEMA).repartition(3)
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    wide = plain.selectExpr("*", *(f"concat('{c}', doc_id) AS {c}" for c in CLASHING))
    for name, stage in corpus_pipeline.STAGES:
        a, b = (stage(spark, df, str(tmp_path)) for df in (plain, wide))
        key = ["doc_id", "piece", "start", "length", "ids_crc32"] if name == "best_fit_packing" else plain.columns
        assert sorted(map(str, a.select(key).collect())) == sorted(map(str, b.select(key).collect())), name
        if name != "best_fit_packing":
            assert b.columns == wide.columns
            assert all(r[c] == (None if r.doc_id is None else f"{c}{r.doc_id}") for r in b.collect() for c in CLASHING)
