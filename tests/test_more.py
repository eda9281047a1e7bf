import json

from pyspark.sql import functions as F

from quillspark.functions import places, statistics as S
from quillspark.operators import relational as R, vectors
from quillspark.sources import records

PID = "S0034-76122020000100001"


def test_records(spark):
    raw = {
        "code": PID, "doi": "https://doi.org/10.1590/A", "year": "x", "language": "pt", "secret": "dropped",
        "titles": [{"language": "pt", "text": "<b>Um</b>  título"}, {"language": "pt", "text": "outro"}, {"language": "en", "text": " "}],
        "keywords": [{"language": "pt", "text": "k"}, {"language": "pt", "text": "k"}],
        "authors": [{"given": "Ana", "surname": "Souza", "orcid": "0000-0002-1825-0097", "affiliations": ["a", "a"]}, {"given": "B", "surname": "C", "orcid": "0000-0002-1825-0098"}],
        "references": [{"title": "R1", "year": "1999", "authors": [{"given": str(i), "surname": f"s{i}"} for i in range(5)]}, {"title": "R2"}],
    }
    df = spark.createDataFrame([(json.dumps(raw),), ("not json",)], "j string")
    [d] = records.documents(df, "j", "first").collect()
    assert (d.id, d.doi, d.year, [t.text for t in d.titles], [k.text for k in d.keywords]) == (PID, "10.1590/a", 2020, ["Um título"], ["k"])
    assert [(a.orcid, a.affiliations) for a in d.authors] == [("0000-0002-1825-0097", ["a"]), (None, None)] and d.abstracts == []
    refs = records.references(df, "j").orderBy("position").collect()
    assert [(r.position, r.title, r.surnames, r.year) for r in refs] == [(1, "R1", ["s0", "s1", "s2"], 1999), (2, "R2", None, None)]
    work = {"id": "W1", "abstract_index": {"b": [1], "a": [0, 2]}, "locations": [{"source": "repo"}, {"source": "J", "issn": ["1"], "licence": "cc-by"}]}
    [w] = records.works(spark.createDataFrame([(json.dumps(work),)], "j string"), "j").collect()
    assert (w.abstract, w.journal, w.licence) == ("a b a", "J", "cc-by")


def test_enrich_fills_only_nulls(spark):
    docs = spark.createDataFrame([("a", "10.1/own", None, "cc-by"), ("b", None, None, None)], "id string, doi string, work string, licence string")
    found = spark.createDataFrame([("W", "10.1/w", 3, "cc-by-nc", None)], "id string, doi string, citations int, licence string, url string")
    matches = spark.createDataFrame([("a", "W", 1)], "doc string, work string, step int")
    assert sorted(tuple(r) for r in records.enrich(docs, matches, found).collect()) == [("a", "10.1/own", "W", "cc-by-nc"), ("b", None, None, None)]


def test_places(spark):
    names = spark.createDataFrame([("Brasil", "BR"), ("Brazil", "BR"), ("Geórgia", "GE"), ("Georgia", "GE"), ("Georgia", "US"), ("Portugal", "PT")], "name string, code string")
    texts = spark.createDataFrame([("BRASIL",), ("Lisboa, Portugal",), ("Brasil / Portugal",), ("Georgia",), (None,)], "t string")
    assert {r.t: r.country for r in places.countries(texts, "t", names).collect()} == {"BRASIL": "BR", "Lisboa, Portugal": "PT", "Brasil / Portugal": None, "Georgia": None}
    got = spark.createDataFrame([("Campinas - SP",), ("Rio (rj)",), ("Paris",)], "t string").select(places.split_city_state(F.col("t"), ["SP", "RJ"]).alias("x")).select("x.*").collect()
    assert [tuple(r) for r in got] == [("Campinas", "SP"), ("Rio", "RJ"), ("Paris", None)]
    cities = spark.createDataFrame([("Belém", "PA", True), ("Belem", "PB", False), ("Niterói", "RJ", False), ("X", "A", False), ("X", "B", False)], "city string, state string, capital boolean")
    assert {r.key: r.state for r in places.state_of_city(cities).collect()} == {"belem": "PA", "niteroi": "RJ"}
    inst = spark.createDataFrame([("i1", "USP"), ("i2", "UF"), ("i3", "UF")], "institution string, acronym string")
    assert [tuple(r) for r in places.acronym_matches(spark.createDataFrame([("Depto, USP, UF",), ("UF",)], "t string"), "t", inst).collect()] == [("Depto, USP, UF", "i1")]


def test_choices_and_sheets(spark):
    a = spark.createDataFrame([("d", "r1", "m", '["x"]'), ("d", "r2", "m", '["x","y"]'), ("d", "r1", "s", "p"), ("d", "r2", "s", "q")], "doc string, rater string, variable string, value string")
    own = S.expand_choices(a, ["doc"], "rater", "variable", "value", {"m": ["x", "y"]})
    pairs = S.rater_pairs(own, ["doc", "variable"], "rater", "value")
    assert sorted(r.variable for r in S.divergences(pairs).collect()) == ["m:y", "s"]
    assert all(r.circular for r in S.circular(pairs, {"r1": "f", "r2": "f"}).collect()) and not any(r.circular for r in S.circular(pairs, {}).collect())
    assert S.valid_codings(a, {"s": ["p"], "m": None}, ["doc"], "variable", "value").count() == 3
    assert S.complete_sheets(a, ["m", "s"], ["doc", "rater"], "variable").count() == 2
    many = spark.createDataFrame([(i, r, "v", "ab"[(i * k) % 2]) for i in range(10) for k, r in enumerate(("r1", "r2", "r3"), 1)], "doc int, rater string, variable string, value string")
    assert S.median_kappa(S.rater_pairs(many, ["doc", "variable"], "rater", "value"), "variable").first().kappa == 0.0


def test_one_per_language(spark):
    t = spark.createDataFrame([("d", "pt", False, 0, "x"), ("d", "pt", True, 1, "y"), ("d", "en", False, 2, "z")], "doc string, lang string, right boolean, at int, text string")
    assert sorted(r.text for r in R.one_per_language(t, ["doc"], "lang", "right", "at").collect()) == ["y", "z"]


def test_spanning_tree_and_grid(spark):
    df = spark.createDataFrame([(g, [x, 0.0]) for g, x in (("a", 0.0), ("b", 1.0), ("c", 3.0)) for _ in range(2)], "g string, v array<double>")
    assert sorted(tuple(r) for r in vectors.spanning_tree(df, "g", "v").collect()) == [("a", "b", 1.0), ("b", "c", 2.0)]
    own = spark.createDataFrame([(i, [1.0, i / 100]) for i in range(12)] + [(50, [0.0, -1.0])], "id int, v array<double>")
    grid = vectors.calibrate(vectors.nearest(own, own, "id", "v", 4), own, "id", [(0.9, 2, 3), (0.9, 2, 100)]).collect()
    assert [(r.clusters, r.largest) for r in grid] == [(1, 12), (0, None)]
