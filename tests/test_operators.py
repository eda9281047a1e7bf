"""Small cases with results derived by hand."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from quillspark.functions import statistics as S, text as T
from quillspark.operators import citations, counting, cube, graph, relational as R, resolve, terms, vectors, voting


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_pair_weights(spark):
    docs = [("d1", "a"), ("d1", "b"), ("d2", "a"), ("d2", "b"), ("d2", "c"), ("d2", "c"), ("d3", "a")]
    pairs = graph.weighted_pairs(spark.createDataFrame(docs, "doc string, member string"), "doc", "member")
    assert rows(pairs, "a", "b", "weight", "documents") == [("a", "b", 1.5, 2), ("a", "c", 0.5, 1), ("b", "c", 0.5, 1)]


def test_three_thirds_are_exactly_one(spark):
    docs = [(d, m) for d in range(3) for m in ("a", "b", f"x{d}", f"y{d}")]
    pairs = graph.weighted_pairs(spark.createDataFrame(docs, "doc int, member string"), "doc", "member").where("a = 'a' AND b = 'b'")
    assert pairs.first().weight == 1.0


def test_strength_equals_summed_weights(spark):
    rng = random.Random(1)
    docs = spark.createDataFrame([(rng.randrange(40), rng.randrange(15)) for _ in range(150)], "doc int, member int")
    strength = dict(rows(graph.strength(docs, "doc", "member"), "member", "strength"))
    weights = dict(rows(graph.degree(graph.weighted_pairs(docs, "doc", "member")), "node", "weight"))
    assert strength.keys() == weights.keys() and all(abs(strength[m] - weights[m]) < 1e-9 for m in strength)


def test_metrics_and_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4), (7, 8)], "a int, b int").withColumns({"weight": F.lit(1.0), "documents": F.lit(1)})
    m = graph.metrics(edges).first()
    assert (m.nodes, m.edges, m.density, m.mean_degree) == (6, 5, 0.333333, 1.667)
    assert m.clustering == round((1 + 1 + 1 / 3) / 6, 4)
    assert rows(graph.component_labels(edges), "node", "component") == [(1, 1), (2, 1), (3, 1), (4, 1), (7, 7), (8, 7)]


def test_louvain_finds_planted_groups(spark):
    cliques = [(10 * g + i, 10 * g + j, 1.0) for g in range(3) for i in range(6) for j in range(i)]
    edges = spark.createDataFrame([(min(a, b), max(a, b), w) for a, b, w in [*cliques, (0, 10, 0.1), (10, 20, 0.1)]], "a int, b int, weight double")
    groups = graph.louvain(edges)
    assert {frozenset(r.nodes) for r in groups.groupBy("community").agg(F.collect_list("node").alias("nodes")).collect()} == {frozenset(range(10 * g, 10 * g + 6)) for g in range(3)}
    assert graph.modularity(edges, groups).first().modularity > 0.6
    assert {r.community for r in graph.numbered_communities(groups, least=7).collect()} == {-1}


@pytest.mark.parametrize(
    "authors,links,expected",
    [
        (2, [(0, "X"), (None, "Y")], {"X": 0.5, "Y": 0.5}),
        (2, [(0, "X")], {"X": 0.5, None: 0.5}),
        (1, [(0, "X"), (None, "Y")], {"X": 0.5, "Y": 0.5}),
        (0, [(None, "X"), (None, "Y")], {"X": 0.5, "Y": 0.5}),
        (0, [], {None: 1.0}),
        (3, [(0, "X"), (0, "Y"), (1, "X"), (2, "Z"), (None, "O")], {"X": 1 / 9 + 1 / 6, "Y": 1 / 9, "Z": 1 / 6, "O": 1 / 9 + 1 / 6 + 1 / 6}),
    ],
)
def test_fractional_counting(spark, authors, links, expected):
    docs = spark.createDataFrame([("d", authors)], "doc string, n_authors int")
    own = spark.createDataFrame([("d", a, i) for a, i in links], "doc string, author int, institution string")
    got = {r.institution: r.weight for r in counting.fractional(docs, own, ["institution"]).collect()}
    assert got.keys() == expected.keys() and all(abs(got[k] - expected[k]) < 1e-12 for k in got)
    assert abs(sum(got.values()) - 1) < 1e-12


def test_votes(spark):
    v = spark.createDataFrame([("i", "p", "absent"), ("i", "p", "absent"), ("i", "q", "literal"), ("j", "p", "literal"), ("j", "p", "absent"), ("j", "q", "absent"), ("k", "p", "absent"), ("k", "p", "absent")], "id string, value string, status string")
    got = {r.id: (r.value, r.stage) for r in voting.decide_single(v, ["id"]).collect()}
    assert got == {"i": (None, "undecided"), "j": ("p", "majority"), "k": ("p", "unanimous")}
    m = spark.createDataFrame([("i", ["a", "b"], "literal"), ("i", ["a"], "literal"), ("i", ["a", "c"], "literal"), ("j", ["a", "b"], "literal"), ("j", ["a", "c"], "literal"), ("j", ["a", "d"], "literal")], "id string, value array<string>, status string")
    got = {r.id: (r.value, r.stage) for r in voting.decide_multiple(m, ["id"]).collect()}
    assert got == {"i": ('["a"]', "majority"), "j": (None, "undecided")}


def test_final_decisions(spark):
    one = spark.createDataFrame([("a", "x", "majority", "h"), ("b", None, "undecided", "h"), ("c", None, "undecided", "h"), ("d", "x", "majority", "h"), ("e", "x", "unanimous", "h")], "id string, value string, stage string, candidates string")
    two = spark.createDataFrame([("b", "y", "majority"), ("c", None, "undecided")], "id string, value string, stage string")
    sup = spark.createDataFrame([("d", "z", "h"), ("e", "z", "old")], "id string, value string, candidates string")
    got = {r.id: (r.value, r.stage, r.flipped) for r in voting.final_decisions(one, two, sup, ["id"]).collect()}
    assert got == {"a": ("x", "majority", False), "b": ("y", "deliberation", False), "c": (None, "no_majority", False), "d": ("z", "supervisor", True), "e": ("x", "unanimous", False)}


def test_kappa_cases(spark):
    same = spark.createDataFrame([("a", "a")] * 3, "x string, y string")
    r = S.agreement(same, "x", "y").first()
    assert r.observed == 1 and r.kappa is None
    assert S.agreement(same.where("false"), "x", "y").first().kappa is None
    r = S.agreement(spark.createDataFrame([("y", "y")] * 20 + [("y", "n")] * 5 + [("n", "y")] * 10 + [("n", "n")] * 15, "x string, y string"), "x", "y").first()
    assert abs(r.kappa - 0.4) < 1e-12 and abs(r.pabak - 0.4) < 1e-12
    assert S.mcnemar_exact(0, 0) == 1.0 and abs(S.mcnemar_exact(1, 9) - 0.021484375) < 1e-12


def test_mcnemar_of_many_pairs():
    """Equal to whole numbers, in seconds: 20,000 pairs took over a minute, a million no bearable time."""
    for b, c in [(0, 1), (3, 3), (4, 3), (0, 40), (7, 22), (500, 430), (1000, 1000), (10_000, 9_800), (9_999, 10_000), (12_000, 8_000)]:
        term = half = 1
        for i in range(min(b, c)):
            term = term * (b + c - i) // (i + 1)
            half += term
        start = time.process_time()
        got = S.mcnemar_exact(b, c)
        assert time.process_time() - start < 5
        assert got == S.mcnemar_exact(c, b) and math.isclose(got, min(1.0, 2 * half / 2 ** (b + c)), rel_tol=1e-12)
    z = 1_999 / math.sqrt(2_000_000)  # with the correction for continuity, close at such counts
    assert math.isclose(S.mcnemar_exact(1_001_000, 999_000), math.erfc(z / math.sqrt(2)), rel_tol=1e-5)
    assert S.mcnemar_exact(5_000_000, 0) == 0.0


def test_alpha_ignores_single_answers(spark):
    own = [(1, "a"), (1, "a"), (2, "a"), (2, "b"), (3, "b"), (3, "b"), (4, "b")]
    with_single = S.krippendorff_alpha(spark.createDataFrame(own, "u int, v string"), "u", "v").first().alpha
    without = S.krippendorff_alpha(spark.createDataFrame(own[:-1], "u int, v string"), "u", "v").first().alpha
    assert with_single == without and abs(with_single - (1 - 5 * 2 / (36 - 18))) < 1e-12


def test_bootstrap_does_not_depend_on_partitions(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(i, rng.choice("ab"), rng.choice("ab")) for i in range(60)], "i int, x string, y string")
    got = {tuple(S.kappa_interval(df.repartition(n), "x", "y", "i", resamples=200).first()) for n in (1, 7)}
    assert len(got) == 1 and next(iter(got))[0] < next(iter(got))[1]
    assert S.kappa_interval(df.limit(9), "x", "y", "i").first().low is None


def test_allocation(spark):
    sizes = spark.createDataFrame([("A", 8), ("B", 1), ("C", 1)], "stratum string, size long")
    assert rows(R.largest_remainder(sizes, 5), "stratum", "allocated") == [("A", 3), ("B", 1), ("C", 1)]
    for n in (0, 1, 2, 3, 7, 10, 50):
        out = R.largest_remainder(sizes, n).collect()
        assert sum(r.allocated for r in out) == min(n, 10) and all(r.allocated <= r.size for r in out)


def test_assignment_is_optimal(spark):
    pairs = spark.createDataFrame([("a", "x", 0.9), ("a", "y", 0.8), ("b", "x", 0.8), ("b", "y", 0.1), ("c", "z", 0.2)], "l string, r string, s double")
    assert rows(R.assignment(pairs, "l", "r", "s", 0.1), "l", "r", "s") == [("a", "y", 0.8), ("b", "x", 0.8), ("c", "z", 0.2)]
    assert rows(R.assignment(pairs, "l", "r", "s", 0.3), "l", "r") == [("a", "y"), ("b", "x")]


def test_excluded(spark):
    docs = spark.createDataFrame([("1", "p"), ("2", None), ("3", "q")], "id string, doi string")
    kept, unmatched = R.excluded(docs, spark.createDataFrame([("q",), ("2",), ("zz",)], "entry string"), ["id", "doi"])
    assert rows(kept, "id") == [("1",)] and rows(unmatched, "entry") == [("zz",)]


def test_polygon_and_filters(spark):
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    points = spark.createDataFrame([(1.0, 1.0), (5.0, 1.0), (2.0, -1.0)], "x double, y double")
    assert [r.i for r in points.select(cube.inside(square, F.col("x"), F.col("y")).alias("i")).collect()] == [True, False, False]
    assert points.where(cube.inside(square[:2], F.col("x"), F.col("y"))).count() == 0
    f = cube.Filters((2020, 2010), {"topic": [3, 1, 3], "nothing": [1], "state": []})
    assert f.encode() == "years=2010-2020&topic=%5B1%2C%203%5D" and cube.Filters.decode(f.encode()) == f.canonical()
    assert cube.Filters.decode("years=x&topic=[&journal=%5B%22a%22%5D") == cube.Filters(None, {"journal": ["a"]})
    circle = [(__import__("math").cos(i / 50), __import__("math").sin(i / 50)) for i in range(314)]
    assert 3 <= len(cube.simplify(circle)) <= 30
    assert cube.log_breaks(60) == [1, 2, 5, 10, 20, 50]


def test_search(spark):
    docs = spark.createDataFrame([(1, "Política pública", "Silva"), (2, "politicas do clima", "Souza"), (3, "outra", "Política")], "id int, title string, authors string")
    assert rows(cube.search(docs, "politica", "id", {"title": 2.0, "authors": 1.0}), "id", "score") == [(1, 2.0), (2, 2.0), (3, 1.0)]
    assert rows(cube.search(docs, "clima polític", "id", {"title": 2.0}), "id") == [(2,)]
    assert cube.search(docs, " ", "id", {"title": 1.0}).count() == 0


def test_identifiers(spark):
    df = spark.createDataFrame([("https://doi.org/10.1590/ABC).", "https://orcid.org/0000-0002-1825-0097"), ("none", "0000-0002-1825-0098"), (None, None)], "d string, o string")
    assert [r.x for r in df.select(T.doi(F.col("d")).alias("x")).collect()] == ["10.1590/abc", None, None]
    assert [r.x for r in df.select(T.orcid_is_valid(T.orcid(F.col("o"))).alias("x")).collect()] == [True, False, None]


def test_licences(spark):
    df = spark.createDataFrame([("CC-BY", "cc-by-nc"), ("https://creativecommons.org/licenses/by-nc/4.0/", None), ("who knows", "cc0"), (None, None)], "a string, b string")
    assert [(r.x, r.y) for r in df.select(T.licence(F.col("a")).alias("x"), T.more_restrictive(T.licence(F.col("a")), T.licence(F.col("b"))).alias("y")).collect()] == [("cc-by", "cc-by-nc"), ("cc-by-nc", "cc-by-nc"), ("other", "other"), (None, None)]


def test_fragment_hash(spark):
    def expected(x):
        h = 2166136261
        for b in x.encode():
            h = (h ^ b) * 16777619 % 2**32
        return f"{h % 64:02x}"

    values = ["", "a", "S0034-76122020000100001", "ção"]
    got = {r.v: r.f for r in spark.createDataFrame([(v,) for v in values], "v string").select("v", T.fragment(F.col("v")).alias("f")).collect()}
    assert got == {v: expected(v) for v in values}


@pytest.mark.parametrize(
    "quote,abstract,title,expected",
    [
        ("Public policy", "On “public policy” today.", None, ("literal", "abstract", 4, 17)),
        ("a title", "nothing of it", "This is a title", ("literal", "title", None, None)),
        ("the quick brown fox jumped over the lazy dog", "we saw the quick brown fox jumps over the lazy dog there", None, ("approximate", "abstract", 7, 50)),
        ("first part ... second part", "first part and much more text, then the second part", None, ("approximate", "abstract", 0, 51)),
        ("never said so at all", "something else entirely", None, ("absent", None, None, None)),
        ("", "x", None, ("absent", None, None, None)),
    ],
)
def test_evidence(quote, abstract, title, expected):
    assert T.check_evidence(quote, abstract, title) == expected


def test_waived_evidence():
    assert T.check_evidence(" . ", "x", None, nothing_stated=True)[0] == "waived"


def test_cleaning():
    assert T.cleaned("<p>A &amp;amp; B</p>\n é") == "A & B é"
    assert T.title_key("Ação &amp; Reação: 2020!") == "acao reacao 2020"
    assert T.without_emails("Univ. X, joao@x.br, maria [at] y [dot] org, Rio") == "Univ. X, , , Rio"


def test_language(spark):
    short = "the of and to in is are was were this that with for by"
    df = spark.createDataFrame([(1, short), (2, short + " from"), (3, "mesa " * 20), (4, "the of and to in " + "el los las del y " * 3)], "id int, t string")
    got = {r.id: r.detected for r in T.language_hits(df, "id", "t").collect()}
    assert got == {1: None, 2: "en", 3: None, 4: "es"}


def test_boilerplate(spark):
    def kept(first, other):
        own = [(i, "Same  Text", "f") for i in range(first)] + [(10 + i, "same text", "o") for i in range(other)]
        return sorted(r.d for r in resolve.boilerplate(spark.createDataFrame(own, "d int, t string, s string"), "d", "t", "s", "f").collect())

    assert kept(2, 0) == [0, 1] and kept(3, 0) == [] and kept(1, 1) == [0] and kept(0, 2) == [] and kept(0, 1) == [10]


def test_deduplicate(spark):
    title = "A long enough title about public policy"
    docs = [
        ("a1", "first", "P1", "10.1/a", 2020, title, "Silva"),
        ("b1", "second", "P1", None, 2020, "other", "X"),  # same pid
        ("b2", "second", None, "10.1/a", 2020, title + "!", "Silva"),  # same doi, titles agree
        ("b3", "second", None, "10.1/a", 2020, "Nothing in common whatsoever, really", "Y"),  # same doi, titles do not
        ("a2", "first", "P2", None, 2020, title, "Silva"),  # same key, same source: suspected
        ("c1", "second", None, None, 2021, "Another quite long title of a study", "Souza"),
        ("c2", "first", "P3", None, 2021, "Another quite long title of a study", "Souza"),  # across sources, no doi
    ]
    out = {r.id: (r.kept, r.suspected) for r in resolve.deduplicate(spark.createDataFrame(docs, "id string, source string, pid string, doi string, year int, title string, surname string"), "first").collect()}
    assert out == {"a1": ("a1", None), "b1": ("a1", None), "b2": ("a1", None), "b3": ("b3", None), "a2": ("a2", "a1"), "c2": ("c2", None), "c1": ("c2", None)}


def test_repeated_doi_and_merge(spark):
    docs = spark.createDataFrame([("a", "x", True), ("b", "x", False), ("c", "y", False), ("d", "y", False)], "id string, doi string, confirmed boolean")
    assert rows(resolve.repeated_doi(docs).where("doi IS NOT NULL"), "id") == [("a",), ("c",), ("d",)]
    own = spark.createDataFrame([("a", None, ["s1"]), ("b", "10.1/x", ["s2", "s1"])], "id string, doi string, origins array<string>")
    kept = spark.createDataFrame([("a", "a"), ("b", "a")], "id string, kept string")
    assert rows(resolve.merge(own, kept, (F.col("id") != F.col("kept")).cast("int")), "id", "doi", "origins") == [("a", "10.1/x", ["s1", "s2"])]


def test_cascade_uses_a_work_once(spark):
    c = spark.createDataFrame([("d1", "w1", 2), ("d1", "w2", 1), ("d2", "w2", 1), ("d2", "w3", 3), ("d3", "w2", 1)], "doc string, work string, step int")
    assert rows(resolve.cascade(c), "doc", "work", "step") == [("d1", "w2", 1), ("d2", "w3", 3)]


def test_people(spark):
    m = [("m1", "Ana Maria Souza", "s1", None, ["x"]), ("m2", "A. M. Souza", "s1", None, ["q"]), ("m3", "Ana Souza", None, None, ["x"]), ("m4", "Ana Souza", None, None, ["z"]), ("m5", "Bruno Lima", None, "o1", []), ("m6", "B. Lima", None, "o1", [])]
    df = spark.createDataFrame(m, "mention string, name string, source_id string, orcid string, context array<string>")
    people = resolve.identify_people(df)
    groups = {frozenset(r.g) for r in people.groupBy("person").agg(F.collect_list("mention").alias("g")).collect()}
    # m4 has no id: it joins the only person of its name, whatever its context
    assert groups == {frozenset({"m1", "m2", "m3", "m4"}), frozenset({"m5", "m6"})}
    apart = resolve.identify_people(df, spark.createDataFrame([("m1", "m3")], "a string, b string"))
    assert {frozenset(r.g) for r in apart.groupBy("person").agg(F.collect_list("mention").alias("g")).collect()} == {frozenset({"m1", "m2"}), frozenset({"m3", "m4"}), frozenset({"m5", "m6"})}


def test_names(spark):
    df = spark.createDataFrame([("João da Silva Jr", "J. Silva Junior", True), ("Ana Souza", "Bia Souza", False), ("Ana Souza", "Ana B. Souza", True)], "a string, b string, same boolean")
    assert all(r.got == r.same for r in df.select("same", resolve.compatible_names(resolve.name_parts(F.col("a")), resolve.name_parts(F.col("b"))).alias("got")).collect())
    al = spark.createDataFrame([(["Ana Souza", "Rui Lima"], ["Rui Lima", "A. Souza"])], "a array<string>, b array<string>").select(resolve.align_authors(F.col("a"), F.col("b")).alias("x")).first().x
    assert al == [1, 0]


def test_institutions(spark):
    inst = spark.createDataFrame([("i1", "Universidade de Campinas", "p1", "BR"), ("i2", "Universidade de Lisboa", "p2", "PT"), ("i3", "Instituto Butantan", "p3", "BR")], "institution string, name string, parent string, country string")
    texts = spark.createDataFrame([("Universidade de Campinas", "BR"), ("Universidade", None), ("Universidade de Lisboa", "BR")], "text string, country string")
    assert rows(resolve.institution_matches(texts, inst), "text", "institution") == [("Universidade de Campinas", "i1")]
    tree = spark.createDataFrame([("a", "b", "lab"), ("b", "c", "faculty"), ("c", None, "education"), ("d", None, "company")], "institution string, parent string, kind string")
    assert rows(resolve.ascend(tree), "institution", "top") == [("a", "c"), ("b", "c"), ("c", "c"), ("d", "d")]


def test_citations(spark):
    docs = spark.createDataFrame([("a", "W1", 2010), ("b", "W2", 2011), ("c", "W3", 2012), ("d", None, 2010)], "doc string, work string, year int")
    refs = spark.createDataFrame([("a", "W2"), ("a", "W3"), ("a", "W1"), ("a", "E1"), ("b", "W1"), ("b", "W1")], "doc string, cited string")
    assert rows(citations.split_references(refs, docs), "doc", "cited", "kind") == [("a", "E1", "external"), ("a", "W1", "self"), ("a", "W2", "internal"), ("a", "W3", "anachronic"), ("b", "W1", "internal")]
    assert rows(citations.coverage(docs, refs), "doc", "n_references") == [("a", 4), ("b", 1), ("c", 0), ("d", -1)]
    same = citations.same_works(spark.createDataFrame([("r1", "silva", "democracy in latin america revisited"), ("r2", "silva", "democracy in latin america"), ("r3", "silva", "something else about markets"), ("r4", "souza", "democracy in latin america")], "record string, surname string, title string"))
    assert rows(same, "record", "work") == [("r1", "r1"), ("r2", "r1"), ("r3", "r3"), ("r4", "r4")]
    years = spark.createDataFrame([("w", 1990)] * 3 + [("w", 1991)] + [("x", y) for y in (1, 2, 3, 4)], "work string, year int")
    assert rows(citations.majority_year(years, "work", "year"), "work") == [("w",), ("x",)]


def test_neighbours_equal_brute_force(spark):
    rng = random.Random(5)
    own = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(60)] + [(100, [0.0] * 8)]
    df = spark.createDataFrame(own, "id int, v array<double>")
    vectors.BLOCK, kept = 16, vectors.BLOCK
    try:
        got = rows(vectors.nearest(df, df, "id", "v", 4), "query", "rank", "neighbour")
    finally:
        vectors.BLOCK = kept

    def cosine(a, b):
        na, nb = sum(x * x for x in a) ** 0.5, sum(x * x for x in b) ** 0.5
        return round(sum(x * y for x, y in zip(a, b, strict=True)) / (na * nb), 9) if na and nb else 0.0

    expected = [(i, r + 1, j) for i, a in own for r, (_, j) in enumerate(sorted((-cosine(a, b), j) for j, b in own if j != i)[:4])]
    assert got == sorted(expected)


def test_keywords_drop_words_in_chosen_pairs(spark):
    w = spark.createDataFrame([("c", "rio janeiro", 0.8), ("c", "janeiro", 0.9), ("c", "rio", 0.7), ("c", "mar", 0.5)], "g string, term string, weight double")
    assert [r.term for r in terms.keywords(w, "g", 3).orderBy("rank").collect()] == ["rio janeiro", "mar"]


def test_ward_joins_near_groups(spark):
    own = [(g, [x + 0.01 * i, 0.0]) for g, x in (("a", 0.0), ("b", 0.5), ("c", 9.0), ("d", 9.5), ("e", 30.0)) for i in range(4)]
    macro = {r.g: r.macro for r in vectors.ward(spark.createDataFrame(own, "g string, v array<double>"), "g", "v", 3).collect()}
    assert macro["a"] == macro["b"] != macro["c"] == macro["d"] and len(set(macro.values())) == 3


def test_density_clusters(spark):
    rng = random.Random(2)
    own = [(10 * g + i, [float(g == 0) + rng.gauss(0, 0.05), float(g == 1) + rng.gauss(0, 0.05), 0.01]) for g in range(2) for i in range(8)] + [(99, [0.0, 0.0, -1.0])]
    df = spark.createDataFrame(own, "id int, v array<double>")
    labels = {r.id: r.label for r in vectors.density_clusters(vectors.nearest(df, df, "id", "v", 5), df, "id", 0.8, 3, 4).collect()}
    assert labels[99] == -1 and {labels[i] for i in range(8)} == {0} and {labels[10 + i] for i in range(8)} == {1}
