import datetime
import gzip
import json

import pytest
from pyspark.sql import functions as F

from quillspark import api
from quillspark.plans import catalog
from quillspark.schemas import DOCUMENT, json_schemas, struct
from quillspark.sources import importers, sinks
from quillspark.streaming import jobs

PID = "S0034-76122020000100001"


def test_ris(spark, tmp_path):
    (tmp_path / "x.ris").write_bytes(f"TY  - JOUR\r\nTI  - A title: part\r\nID  - {PID}-scl\r\nPY  - 2020/01\r\nER  - \r\nTY  - JOUR\r\nTI  - No identifier\r\nER  - \r\n".encode())
    a, b = importers.read_export(spark, f"{tmp_path}/x.ris").orderBy("title").collect()
    assert (a.pid, a.collection, a.title, a.year, a.origin, a.ignored) == (PID, "scl", "A title: part", 2020, "x.ris", False)
    assert b.ignored and b.title == "No identifier"


def test_bibtex(spark, tmp_path):
    (tmp_path / "x.bib").write_text("@article{K1,\n  title = {{A Title}},\n  year = {2019},\n  crossref = {10.1590/ABC},\n}\n@misc{K2,\n  url = {http://www.example.br/x?pid=" + PID + "},\n}\n")
    a, b = importers.read_export(spark, f"{tmp_path}/x.bib").orderBy(F.desc_nulls_last("title")).collect()
    assert (a.doi, a.title, a.year) == ("10.1590/abc", "A Title", 2019)
    assert (b.pid, b.collection) == (PID, "br")


def test_csv_in_two_encodings(spark, tmp_path):
    (tmp_path / "x.csv").write_text(f'ID;Title;Publication year;Fulltext URL \n "{PID}" ; " A, title ";2018; http://x/10.1/y\n', encoding="utf-8-sig")
    [r] = importers.read_export(spark, f"{tmp_path}/x.csv").collect()
    assert (r.pid, r.title, r.year) == (PID, "A, title", 2018)
    (tmp_path / "y.ris").write_bytes("TI  - Ação\r\nDO  - 10.1590/x\r\nER  - \r\n".encode("cp1252"))
    assert importers.read_export(spark, f"{tmp_path}/y.ris").first().title == "Ação"
    with pytest.raises(ValueError, match="cannot import"):
        importers.read_export(spark, "x.doc")


def test_list(spark, tmp_path):
    (tmp_path / "x.txt").write_text(f"# comment\n10.1590/A # why\nhttp://example.org/{PID}\nnonsense\n")
    got = sorted((r.doi or "", r.pid or "", r.ignored) for r in importers.read_export(spark, f"{tmp_path}/x.txt").collect())
    assert got == [("", "", True), ("", PID, False), ("10.1590/a", "", False)]


def test_answers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"doc": "d1", "answers": {"v": "x"}}\n{"doc": "d9", "answers": {"v": "x"}}\nnot json\n{"doc": "d2"}\n')
    good, bad = importers.read_answers(spark, f"{tmp_path}/a.jsonl", spark.createDataFrame([("d1",), ("d2",)], "doc string"))
    assert [tuple(r) for r in good.collect()] == [("d1", "v", "x")]
    assert sorted(r.reason for r in bad.collect()) == ["no document or answers", "not JSON", "not in the sample"]


def test_paged_listing(spark, tmp_path):
    (tmp_path / "j1").mkdir()
    for k, codes in enumerate(([PID, "S0034-76122015000100001"], [PID, "S0034-76122021000100009"])):
        with gzip.open(tmp_path / "j1" / f"{k:05d}.json.gz", "wt") as f:
            json.dump({"meta": {"total": 4}, "objects": [{"code": c, "collection": "scl"} for c in codes]}, f)
    spark.dataSource.register(importers.PagedDataSource)
    df = spark.read.format("paged_listing").option("path", str(tmp_path)).option("journals", "j1,none").option("years", "2018-2022").load()
    assert sorted((r.code, r.year) for r in df.collect()) == [(PID, 2020), ("S0034-76122021000100009", 2021)]


def test_lookup_and_unambiguous(spark):
    keys = spark.createDataFrame([(f"k{i}",) for i in range(30)], "k string")
    batches = importers.lookup(keys, keys.where("k < 'k2'"), "k", 5).collect()
    assert sorted(x for b in batches for x in b["keys"]) == sorted(f"k{i}" for i in range(30) if f"k{i}" >= "k2") and all(len(b["keys"]) <= 5 for b in batches)
    ref = spark.createDataFrame([("a", "1"), ("a", "1"), ("b", "1"), ("b", "2")], "k string, v string")
    assert [tuple(r) for r in importers.unambiguous(ref, "k", "v").collect()] == [("a", "1")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "z"), (1, "a"), (3, None)], "k int, v string")
    first = None
    for n in (1, 4):
        sinks.write_table(df.repartition(n), f"{tmp_path}/t{n}.parquet", ["k"], files=1)
        [file] = (tmp_path / f"t{n}.parquet").glob("*.parquet")
        first = first or file.read_bytes()
        assert file.read_bytes() == first
    out = sinks.columnar(df, ["k"], ["v"])
    assert out["columns"] == {"k": [1, 1, 2, 3], "v": [0, 2, 1, -1]} and out["dictionaries"] == {"v": ["a", "b", "z"]}
    sinks.write_fragments(df, f"{tmp_path}/f", "v")
    assert spark.read.json(f"{tmp_path}/f").count() == 4
    assert sinks.private_rows(spark.createDataFrame([("x@y.org",), ("x",)], "v string"), ["v"]) == 1
    assert sinks.materialise(df.limit(1).select("k"), "tuples") == [(2,)] and "| k |" in sinks.markdown(df.select("k")) and "tabular" in sinks.latex(df)
    assert "fields" in json_schemas({"d": DOCUMENT})["d"]


def document(i, **more):
    base = dict.fromkeys(struct(DOCUMENT).names)
    return base | {"id": i, "source": "first", "origins": ["s"], "kind": "article", "year": 2020, "titles": [("pt", f"Um título comprido sobre o assunto {i}", "s")], "abstracts": [], "authors": [("Ana", "Souza", None, []), ("Rui", "Lima", None, [])]} | more


def test_project(spark, tmp_path):
    docs = spark.createDataFrame([document("a"), document("b", year=2010), document("c", kind="letter"), document("d", doi="10.1/d"), document("e", authors=[], abstracts=[("en", "x", "s")])], struct(DOCUMENT))
    project = api.open_project(spark, f"{tmp_path}/p")
    counts = project.collect(docs, "first", kinds=["article"], period="2015-2024", exclude=spark.createDataFrame([("10.1/d",), ("zz",)], "entry string"))
    assert counts == {"read": 5, "unmatched_exclusions": 1, "written": 2}
    assert project.query("SELECT id, position, surname FROM authors ORDER BY position", "tuples") == [("a", 1, "Souza"), ("a", 2, "Lima")]
    assert project.query("SELECT kind, count(*) AS n FROM texts GROUP BY kind ORDER BY kind", "tuples") == [("abstract", 1), ("title", 2)]
    assert project.coverage()["with_authors"] == 1 and project.networks() == {"edges": 1, "people": 2}
    links = spark.createDataFrame([("a", 0, "i1", "SP", "BR")], "doc string, author int, institution string, state string, country string")
    project.geography(links)
    assert project.query("SELECT round(sum(weight), 9) AS w FROM weights", "tuples") == [(2.0,)]
    ran = [project.stage("x", [project.read("documents")], lambda: {"n": 1}) for _ in range(2)]
    assert ran == [True, False]
    asked = project.classify(spark.createDataFrame([("a", "It says yes here.")], "doc string, text string"), lambda body: {"v": ("yes", "says yes")}, "m1")
    assert asked == {"asked": 1}
    [row] = spark.read.parquet(f"{tmp_path}/p/classifications/m1.parquet").collect()
    assert (row.status, row.start, row.end) == ("literal", 3, 11)
    assert catalog.with_run(spark, f"{tmp_path}/p/classifications").first().run == "m1"
    project.publish(f"{tmp_path}/out", {"weights": (project.read("weights"), ["doc"])})
    assert json.loads((tmp_path / "out" / "manifest.json").read_text()) == {"tables": ["weights"]}
    with pytest.raises(ValueError, match="years"):
        api.years("2020-2010")


def test_job_events(spark, tmp_path):
    at = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s)
    events = [("j", 1, "started", 0, 10, None, at(0)), ("j", 2, "progress", 2, 10, "x", at(4)), ("j", 3, "progress", 4, 10, None, at(8)), ("k", 1, "failed", None, None, "no", at(1))]
    df = spark.createDataFrame(events, jobs.EVENTS)
    got = {r.job: (r.status, r.done, r.message, r.last_seq) for r in jobs.state(df).collect()}
    assert got == {"j": ("started", 4, "x", 3), "k": ("failed", None, "no", 1)}
    assert [r.seq for r in jobs.since(df, "j", 1).collect()] == [2, 3]
    assert {r.job: r.seconds for r in jobs.remaining(df.where("job = 'j'"), 2).collect()} == {"j": 6.0}


def test_incremental_stage_repeats_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = "doc string, text string"

    def step(k, rows):
        (tmp_path / "in" / f"{k}.json").write_text("".join(json.dumps(r) + "\n" for r in rows))
        source = spark.readStream.schema(schema).json(f"{tmp_path}/in")
        jobs.incremental(source, f"{tmp_path}/done", ["doc"], lambda b: b.withColumn("n", F.length("text")), f"{tmp_path}/cp").awaitTermination()

    step(1, [{"doc": "a", "text": "xx"}, {"doc": "a", "text": "xx"}])
    step(2, [{"doc": "a", "text": "xx"}, {"doc": "b", "text": "yyy"}])
    assert sorted((r.doc, r.n) for r in spark.read.parquet(f"{tmp_path}/done").collect()) == [("a", 2), ("b", 3)]


def test_windowed_stream(spark, tmp_path):
    (tmp_path / "ev").mkdir()
    (tmp_path / "ev" / "1.json").write_text('{"ts": "2024-01-01T00:10:00Z", "k": "a"}\n{"ts": "2024-01-01T00:50:00Z", "k": "a"}\n{"ts": "2024-01-01T01:10:00Z", "k": "a"}\n')
    stream = jobs.windowed_counts(spark.readStream.schema("ts timestamp, k string").json(f"{tmp_path}/ev"), "ts", ["k"])
    stream.writeStream.format("memory").queryName("windowed").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.n for r in spark.table("windowed").collect()) == [1, 2]
