"""Addresses, evidence, codebooks, corrections, rounding, matches: cases whose results follow from the rules."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions import addresses as A, codebook as C, evidence as E
from quillspark.functions.rounding import half_even
from quillspark.operators import graph, relational as R, resolve
from quillspark.sources import corrections, sinks

ADDRESSES = """Univ. X, fulana @exemplo.br
Univ. X, fulana@exemplo. br
Univ. X, fulana@ exemplo.com.br
Univ. X, fulana.silva@ exemplo.es
Univ. X, f.b.silva@exemplo. com
beltrano [at] exemplo [dot] br
ciclano {at} exemplo.br
joao (arroba) exemplo (ponto) br
maria@exemplo.com.br
UAB, Barcelona. fulana@ exemplo.cat
Univ. X. fulana (arroba) exemplo (ponto) ac (ponto) id
Univ. X. fulana@exemplo (ponto) es
Univ. X. fulana＠exemplo.br
Univ. X. chen﹫exemplo.edu.tw
Univ. X. fulana@exemplo (ponto) ufrj.br
Univ. X. fulana@dcc.exemplo (ponto) br""".splitlines()
NONE = """p @ 0.05 no teste
O perfil @fulano. Em seguida
looking at data. Results
RT @usuario: texto
Analisamos o perfil @maria.silva no Instagram
tweets de @lula.oficial e @bolsonaro.sp
look [at] data.table and dplyr
Recall@10. results show
@frente.pe publicou
entre tod@s. no entanto, o grupo
alun@s. na escola
com P@10. de acordo""".splitlines()


@pytest.mark.parametrize("text", ADDRESSES)
def test_addresses_go(text):
    clean = A.without_emails(text)
    assert A.contains_email(text) and not A.contains_email(clean) and "exemplo" not in clean


@pytest.mark.parametrize("text", NONE)
def test_what_is_no_address_stays(text):
    assert not A.contains_email(text) and A.without_emails(text) == text


@pytest.mark.parametrize(
    "text,clean",
    [
        ("UFRJ. fulana @exemplo.br", "UFRJ. fulana"),
        ("UFRJ. fulana @exemplo.br-RJ", "UFRJ. fulana -RJ"),
        ("as contas @governo.es e @camara.ms", "as contas e"),
        ("a página @jornal.do.commercio", "a página"),
        ("Univ. X, fulana@uf­exemplo.br", "Univ. X"),
        ("Univ. X, fu‌lana@exemplo‍.com.br", "Univ. X"),
        ("Univ. X, chen@exemplo．edu．tw", "Univ. X"),
        ("fulana @ x.br.joao@y.br", ""),
        ("Política­pública e partici​pação．Fim", "Política­pública e partici​pação．Fim"),
    ],
)
def test_cleaned_texts(text, clean):
    assert A.without_emails(text) == clean and not A.contains_email(clean)


def test_publication_uses_the_same_detector(spark):
    df = spark.createDataFrame([(t,) for t in [*ADDRESSES, *NONE, None]], "t string")
    assert sinks.private_rows(df, ["t"]) == len(ADDRESSES)


def test_printed_tables_are_whole_or_not_at_all(spark):
    assert sinks.markdown(spark.range(1000)).count("\n") == 1001
    for form in (sinks.markdown, sinks.latex):
        with pytest.raises(ValueError, match="up to 1000 rows"):
            form(spark.range(1001))


def brute_place(text, quote):
    """Least cost over all pieces by a plain table of edits."""
    best = None
    for a in range(len(text) + 1):
        row = [2 * i for i in range(len(quote) + 1)]  # cost of quote[:i] against text[a:a]
        ends = [row[-1]]
        for c in text[a:]:
            new = [row[0] + 1]
            for i, q in enumerate(quote, 1):
                new.append(min(row[i] + 1, new[i - 1] + 2, row[i - 1] if q == c else 10**9))
            row = new
            ends.append(row[-1])
        for n, cost in enumerate(ends):
            key = (cost, a + n, n)
            if best is None or key < best[0]:
                best = key, (a, a + n)
    return best[0][0], best[1]


def test_best_place_equals_all_pieces():
    rng = random.Random(1)
    for _ in range(150):
        text, quote = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 25))), "".join(rng.choice("abc ") for _ in range(rng.randint(1, 10)))
        cost, place = brute_place(text, quote)
        a, b, found = E.best_place(text, quote)
        assert (a, b) == place and 2 * (len(quote) - found) + (b - a - found) == cost


SUMMARY = "Este artigo analisa  a “polarização afetiva” no Brasil entre 2014 e 2022 — com dados do ESEB — e mostra que eleitores de esquerda e de direita se afastaram."
LONG = (
    "O artigo examina a formação de coalizões nos governos estaduais brasileiros entre 1995 e 2018. A partir de um banco de dados "
    "original sobre a composição dos secretariados, mostra que os governadores distribuem as pastas de modo proporcional ao peso "
    "legislativo dos partidos aliados, mas reservam as áreas de maior orçamento para o próprio partido. Os resultados indicam que a "
    "lógica da coalizão no plano estadual se aproxima da observada no governo federal. "
) * 2


@pytest.mark.parametrize(
    "quote,text,title,status,field,marked",
    [
        ("A polarização afetiva no Brasil", SUMMARY, None, "literal", "abstract", "a “polarização afetiva” no Brasil"),
        ("  «Eleitores de esquerda e de direita se afastaram.»  ", SUMMARY, None, "literal", "abstract", "eleitores de esquerda e de direita se afastaram"),
        ("eleitores da esquerda e de direita se afastaram", SUMMARY, None, "approximate", "abstract", "eleitores de esquerda e de direita se afastaram"),
        ("o artigo usa entrevistas em profundidade com deputados", SUMMARY, None, "absent", None, None),
        ("Polarização afetiva", "Outro resumo qualquer.", "Polarização afetiva no Brasil", "literal", "title", None),
        ("survey com amostra nacional", LONG, None, "absent", None, None),
        ("os dados mostram a importância das redes", LONG, None, "absent", None, None),
        ("os governadores distribuem as pastas de modo proporcional ao peso eleitoral dos partidos", LONG, None, "approximate", "abstract", "os governadores distribuem as pastas de modo proporcional ao peso legislativo dos partidos"),
        ("formação de coalizões nos governos estaduais ... survey com amostra nacional", LONG, None, "absent", None, None),
        ("Coalizões estaduais ... a lógica da coalizão no plano estadual", LONG, "Coalizões estaduais no Brasil", "approximate", "abstract", "a lógica da coalizão no plano estadual"),
    ],
)
def test_evidence_cases(quote, text, title, status, field, marked):
    got = E.check_evidence(quote, text, title)
    assert got[:2] == (status, field) and (None if got[2] is None else text[got[2] : got[3]]) == marked


def test_rounding_is_half_to_even(spark):
    values = [0.125, 0.375, 2.675, 0.5, 1.5, -0.125, 1e-9, 123456.789, None]
    got = [r.x for r in spark.createDataFrame([(v,) for v in values], "v double").select(half_even(F.col("v"), 2).alias("x")).collect()]
    assert got == [0.12, 0.38, 2.68, 0.5, 1.5, -0.12, 0.0, 123456.79, None]


def test_numbers_without_one_task(spark):
    df = spark.createDataFrame([(i % 7, i) for i in range(200)], "a int, b int").repartition(5)
    got = R.numbered(df, [F.desc("a"), F.col("b")], "n", 10).collect()
    assert [(r.a, r.b) for r in sorted(got, key=lambda r: r.n)] == sorted(((i % 7, i) for i in range(200)), key=lambda x: (-x[0], x[1]))
    assert sorted(r.n for r in got) == list(range(10, 210))


VARIABLES = [C.Variable("m", C.CHOICE, ("x", "y", "nao_informado")), C.Variable("k", C.CHOICES, ("a", "b")), C.Variable("b", C.YES_NO), C.Variable("t", C.TEXT)]


def test_answers_against_a_codebook():
    good = C.check_answer({"m": {"value": "x", "quote": "q"}, "k": {"value": ["b", "b", "a"], "quote": ""}, "b": {"value": True, "quote": ""}, "t": {"value": " NAO_INFORMADO. ", "quote": "z"}}, VARIABLES)
    assert not good.problems and good.values == {"m": "x", "k": ["b", "a"], "b": True, "t": "não informado"}
    bad = C.check_answer({"m": {"value": "w", "quote": "q"}, "k": {"value": "a", "quote": ""}, "b": {"value": 1, "quote": ""}}, VARIABLES)
    assert [p.split(":")[0] for p in bad.problems] == ["m", "k", "b", "t"] and C.best_of([bad, good]) is good
    assert C.check_answer([], VARIABLES).problems == ["the answer is no JSON object"]
    assert C.answer_schema(VARIABLES)["properties"]["k"]["properties"]["value"]["uniqueItems"]
    for kind, value in ((C.YES_NO, False), (C.CHOICES, ["é", "b"]), (C.TEXT, "x"), (C.CHOICE, "y")):
        assert C.from_text(C.as_text(value), kind) == value


def test_classification_reports(spark):
    rows = [("d1", "m", "choice", "x", "literal"), ("d2", "m", "choice", "nao_informado", "waived"), ("d3", "m", "choice", "x", "approximate"), ("d1", "k", "choices", '["a", "b"]', "literal"), ("d2", "k", "choices", "[]", "waived"), ("d1", "t", "text", "Não se aplica.", "absent"), ("d1", "b", "yes_no", "false", "literal")]
    df = spark.createDataFrame(rows, "doc string, variable string, kind string, value string, status string")
    got = {(r.variable, r.status): (r.n, r.no_answer, r.share) for r in C.classification_summary(df).collect()}
    assert got == {("m", "literal"): (3, 0.3333, 0.5), ("m", "approximate"): (3, 0.3333, 0.5), ("k", "literal"): (2, 0.5, 1.0), ("t", "absent"): (1, 1.0, 1.0), ("b", "literal"): (1, 1.0, 1.0)}
    assert {(r.variable, r.value): r.n for r in C.value_counts(df).collect()} == {("m", "x"): 2, ("m", "nao_informado"): 1, ("k", "a"): 1, ("k", "b"): 1, ("b", "false"): 1}
    docs = spark.createDataFrame([("d1", "p"), ("d2", "p"), ("d3", "q"), ("d4", None)], "doc string, g string")
    assert {(r.g, r.value): r.n for r in C.cross_tab(docs, df, "k", "g").collect()} == {("p", "a"): 1, ("p", "b"): 1, ("p", "unclassified"): 1, ("q", "unclassified"): 1, (None, "unclassified"): 1}
    assert [r.doc for r in C.cell_documents(docs, df, "k", "g", "p", "a").collect()] == ["d1"]
    assert [r.doc for r in C.cell_documents(docs, df, "m", "g", None, "unclassified").collect()] == ["d4"]
    text = "array<struct<language:string,text:string,origin:string>>"
    t = spark.createDataFrame([("a", [("pt", "T", ""), ("en", "U", "")], [("en", "E", "")]), ("b", [("pt", "T", "")], [("es", " ", "")]), ("c", [("pt", "T", "")], [("es", "S", "")])], f"d string, titles {text}, abstracts {text}")
    got = {r.d: r.x and tuple(r.x) for r in t.select("d", C.classification_texts(F.col("titles"), F.col("abstracts"), ["pt", "en"]).alias("x")).collect()}
    assert got == {"a": ("U", "E", "en"), "b": None, "c": ("T", "S", "es")}


def test_jury_reports(spark):
    reference = spark.createDataFrame([("d1", "m", "x"), ("d2", "m", "y")], "doc string, variable string, value string")
    decisions = spark.createDataFrame([("d1", "m", "x", "unanimous"), ("d2", "m", "x", "majority"), ("d3", "m", "x", "majority"), ("d2", "q", None, "undecided")], "doc string, variable string, value string, stage string")
    assert {r.stage: (r.n, r.right) for r in C.agreement_by_stage(decisions, reference).collect()} == {"unanimous": (1, 1), "majority": (1, 0)}
    votes = [("d1", "m", "A", 1, "y", False), ("d1", "m", "A", 2, "x", True), ("d2", "m", "A", 1, "y", False), ("d2", "m", "A", 2, "x", True), ("d1", "m", "B", 1, "x", False), ("d1", "m", "B", 2, "x", False)]
    got = C.votes_moved(spark.createDataFrame(votes, "doc string, variable string, member string, round int, value string, revised boolean"), reference)
    assert {r.member: (r.votes, r.changed, r.towards, r.against) for r in got.collect()} == {"A": (2, 2, 1, 1), "B": (1, 0, 0, 0)}


def test_corrections(spark, tmp_path):
    (tmp_path / "people.yaml").write_text("together:\n  - [source:A1, name:ana]\napart:\n  - [source:A1, d3]\nnames:\n  source:A1: Ana M.\n")
    people = corrections.read_people(f"{tmp_path}/people.yaml")
    assert people == corrections.People([["source:A1", "name:ana"]], [["source:A1", "d3"]], {"source:A1": "Ana M."})
    assert corrections.read_people(f"{tmp_path}/none.yaml") == corrections.People()
    (tmp_path / "empty.yaml").write_text("together:\n")
    assert corrections.read_people(f"{tmp_path}/empty.yaml") == corrections.People()
    for text, message in (("together:\n  - a, b\n", "list of ids in brackets"), ("other: 1\n", "not one of"), ("apart:\n  - [a]\n", "is a pair"), ("a: [", "no YAML")):
        (tmp_path / "bad.yaml").write_text(text)
        with pytest.raises(corrections.CorrectionError, match=message):
            corrections.read_people(f"{tmp_path}/bad.yaml")
    ids = spark.createDataFrame([("source:A1", "d1"), ("source:A1", "d2"), ("source:A1", "d3"), ("d3", "d3")], "id string, mention string")
    assert sorted(tuple(r) for r in corrections.mention_pairs(spark, people.apart, ids).collect()) == [("d1", "d3"), ("d2", "d3")]
    (tmp_path / "inst.yaml").write_text("aliases:\n  IESP: I12\ninstitutions:\n  cem: {name: Centro, country: BR}\n")
    aliases, own = corrections.read_institutions(spark, f"{tmp_path}/inst.yaml")
    assert aliases == {"IESP": "I12"} and [tuple(r) for r in own.collect()] == [("cem", "Centro", "BR", None)]
    (tmp_path / "bad.yaml").write_text("institutions:\n  'é x': {name: q}\n")
    with pytest.raises(corrections.CorrectionError, match="is no id"):
        corrections.read_institutions(spark, f"{tmp_path}/bad.yaml")
    (tmp_path / "labels.yaml").write_text("topics:\n  3: Clima\n")
    assert [tuple(r) for r in corrections.read_labels(spark, f"{tmp_path}/labels.yaml").collect()] == [(3, "Clima")]


def test_match_cascade(spark):
    long = "A very long title about the politics of water"
    docs = spark.createDataFrame(
        [
            ("d1", "10.1/A", "S0104-62762020000100001", 2020, ["Title one of some length"]), ("d2", None, "S0104-62762020000100002", 2020, ["Second"]), ("d3", None, "S0104-62762020000100003", 2020, ["Third"]),
            ("d4", None, None, 2021, ["x", "Fourth title, here"]), ("d5", "10.1/z", None, 2010, [long]), ("d6", "10.1/y", None, 2010, ["Short"]), ("d7", "10.1/a", None, 2020, []), ("d8", "10.1/q", None, 2020, ["Nothing alike"]),
        ],
        "id string, doi string, pid string, year int, titles array<string>",
    )
    works = spark.createDataFrame(
        [
            ("w1", "10.1/a", [], 2021, "Title one of some length"), ("w2", None, ["https://x/S0104-62762020000100002/en"], 2020, "Second"), ("w3", "10.1590/s0104-62762020000100003", None, 2020, "Third"),
            ("w4", None, [], 2021, "fourth TITLE here"), ("w5", "10.1/z", [], 2016, long + "!"), ("w6", "10.1/y", [], 2016, "Short"), ("w8", "10.1/q", [], 2020, "Completely other words"),
        ],
        "id string, doi string, urls array<string>, year int, title string",
    )
    got = sorted(tuple(r) for r in resolve.match_works(docs, works).collect())
    # d6: another year and a short title; d7: its work went to d1, which comes first; d8: other titles
    assert got == [("d1", "w1", 1), ("d2", "w2", 2), ("d3", "w3", 3), ("d4", "w4", 4), ("d5", "w5", 1)]


def test_hydration(spark):
    entries = spark.createDataFrame([(1, "P1", None), (2, "P9", "10.1/B"), (3, None, "10.1/c"), (4, None, None), (5, "P8", "10.1/x")], "entry int, pid string, doi string")
    records = spark.createDataFrame([("r1", "p1", None), ("r2", None, "10.1/b")], "id string, pid string, doi string")
    works = spark.createDataFrame([("w3", "10.1/C"), ("w2", "10.1/b")], "id string, doi string")
    found, left = resolve.hydrate(entries, records, works)
    assert sorted(tuple(r) for r in found.collect()) == [(1, "r1", 1), (2, "r2", 2), (3, "w3", 3)] and sorted(r.entry for r in left.collect()) == [4, 5]


def test_community_summary(spark):
    groups = spark.createDataFrame([("a", 0), ("b", 0), ("c", 1), ("z", -1)], "node string, community int")
    members = spark.createDataFrame([("d1", "a"), ("d1", "b"), ("d2", "b"), ("d3", "a"), ("d4", "z")], "doc string, node string")
    topics = spark.createDataFrame([("d1", 5, 1), ("d2", 4, 1), ("d3", 5, 2), ("d4", 9, 9)], "doc string, topic int, macro int")
    labels = spark.createDataFrame([(4, "Four"), (5, "Five")], "topic int, label string")
    got = {r.community: (r.n, r.documents, r.macro, r.topics, r.label) for r in graph.community_summary(groups, members, topics, labels).collect()}
    assert got == {0: (2, 3, 1, [5, 4], "Five · Four"), 1: (1, 0, None, [], "no topic")}


def test_hub_components(spark, monkeypatch):
    monkeypatch.setattr(graph, "HUB_EDGES", 3)
    edges = [(0, i) for i in range(1, 60)] + [(100, 59), (200, 201), (201, 202), (300, 300), (500, 400), (500, 401), (500, 402), (500, 403), (500, 404)]
    got = {r.node: r.component for r in graph.component_labels(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in [*range(60), 100]} | {200: 200, 201: 200, 202: 200, 300: 300, 500: 400, 400: 400, 401: 400, 402: 400, 403: 400, 404: 400}


def test_classification_asks_again_and_keeps_the_best(spark, tmp_path):
    from quillspark.api import open_project

    (tmp_path / "calls").mkdir()
    calls = str(tmp_path / "calls")

    def provider(text, problems):
        import uuid

        open(f"{calls}/{uuid.uuid4().hex}", "w").close()
        good = {"m": {"value": "x", "quote": "seen here"}, "k": {"value": ["a"], "quote": "no such words at all"}, "b": {"value": False, "quote": ""}, "t": {"value": "period", "quote": "here"}}
        return good if problems or "fine" in text else {"m": {"value": "wrong", "quote": ""}}

    asked = lambda: len(list((tmp_path / "calls").iterdir()))
    project = open_project(spark, f"{tmp_path}/p")
    texts = spark.createDataFrame([("d1", "It was seen here, all fine."), ("d2", "It was seen here.")], "doc string, text string")
    assert project.classify_by_codebook(texts, VARIABLES, provider, "r") == {"asked": 2} and asked() == 3
    rows = spark.read.parquet(f"{tmp_path}/p/answers/r.parquet").collect()
    assert {(r.doc, r.tries, r.problems) for r in rows} == {("d1", 1, 0), ("d2", 2, 0)}
    assert {r.variable: r.status for r in rows if r.doc == "d2"} == {"m": "literal", "k": "absent", "b": "waived", "t": "literal"}
    assert project.classify_by_codebook(texts, VARIABLES, provider, "r") == {"asked": 0} and asked() == 3
    assert project.classify_by_codebook(texts.withColumn("text", F.concat("text", F.lit(" fine"))), VARIABLES, provider, "r") == {"asked": 2}
    assert project.classify_by_codebook(texts, VARIABLES[:1], provider, "r") == {"asked": 2}
