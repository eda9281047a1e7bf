"""Named queries of importers, picks, reports, resolution and jobs over the test tables, each with its SQL.

What an importer reads is first written from a table to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.api import years
from quillspark.functions import codebook as C, names as N, places, statistics as S, text as T
from quillspark.operators import citations, counting, cube, graph, institutions as I, relational as R, resolve, terms, voting
from quillspark.plans import catalog
from quillspark.plans.registry import query
from quillspark.schemas import CLASSIFICATIONS, struct
from quillspark.session import shared_folder
from quillspark.sources import importers, records, sinks
from quillspark.streaming import jobs
from quillspark.tables import table

# ---- importers -------------------------------------------------------------------


@query("""
    SELECT CAST(doc_id AS VARCHAR) AS doc, variable, CAST(value AS VARCHAR) AS value, 'run-' || variable AS run
    FROM (SELECT doc_id, 'quality' AS variable, quality AS value FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels)
""")
def runs_by_file_name(spark, sf):
    """Two runs, each a file of its own, read together with the name of the file."""
    folder = shared_folder(spark, "runs")
    own = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("doc"), "quality", "toxic")
    for v in ("quality", "toxic"):
        rows = own.select(*(F.col("doc") if f.name == "doc" else F.lit(v).alias("variable") if f.name == "variable" else F.col(v).cast("string").alias("value") if f.name == "value" else F.lit(None).cast(f.dataType).alias(f.name) for f in struct(CLASSIFICATIONS)))
        rows.write.parquet(f"{folder}/run-{v}.parquet")
    return catalog.with_run(spark, folder).select("doc", "variable", "value", "run")


@query("""
    SELECT CAST(doc_id AS VARCHAR) AS doc, variable, CAST(value AS VARCHAR) AS value
    FROM (SELECT doc_id, 'quality' AS variable, quality AS value FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels) JOIN documents USING (doc_id) WHERE source = 'src0'
""")
def imported_answers(spark, sf):
    """Answers as JSON lines, of which those to documents of the sample count."""
    path = shared_folder(spark, "answers")
    rows = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("doc"), F.create_map(F.lit("quality"), F.col("quality").cast("string"), F.lit("toxic"), F.col("toxic").cast("string")).alias("answers"))
    rows.write.json(path)
    sample = table(spark, sf, "documents").where("source = 'src0'").select(F.col("doc_id").cast("string").alias("doc"))
    return importers.read_answers(spark, path, sample)[0]


IMPORTED = "SELECT '10.1590/x' || CAST(doc_id AS VARCHAR) AS doi, lang || ' ' || CAST(doc_id AS VARCHAR) AS title, CAST(2000 + doc_id % 25 AS INTEGER) AS year FROM documents"


def _entries(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("doc_id").cast("string")
    return table(spark, sf, "documents").select(key.alias("key"), F.concat(F.lit("10.1590/X"), key).alias("doi"), F.concat_ws(" ", "lang", key).alias("title"), (2000 + F.col("doc_id") % 25).cast("string").alias("year"))


@query(IMPORTED)
def ris_import(spark, sf):
    path = shared_folder(spark, "ris")
    e = _entries(spark, sf)
    e.select(F.concat(F.lit("TY  - JOUR\nID  - r"), "key", F.lit("\nTI  - "), "title", F.lit("\nDO  - "), "doi", F.lit("\nPY  - "), "year", F.lit("\nER  - \n"))).write.text(path)
    return importers.read_ris(spark, path).select("doi", "title", "year")


@query(IMPORTED)
def bibtex_import(spark, sf):
    path = shared_folder(spark, "bib")
    e = _entries(spark, sf)
    e.select(F.concat(F.lit("@article{r"), "key", F.lit(",\n  title = {{"), "title", F.lit("}},\n  year = {"), "year", F.lit("},\n  crossref = {"), "doi", F.lit("},\n}\n"))).write.text(path)
    return importers.read_bibtex(spark, path).select("doi", "title", "year")


@query(IMPORTED)
def csv_import(spark, sf):
    path = shared_folder(spark, "csv")
    e = _entries(spark, sf)
    e.select(F.concat(F.lit('r'), "key").alias("ID"), F.concat(F.lit(" "), "title", F.lit(" ")).alias("Title"), F.col("doi").alias("DOI"), F.col("year").alias("Publication year")).write.option("header", True).option("sep", ";").csv(path)
    return importers.read_csv(spark, path).select("doi", "title", "year")


@query("SELECT '10.1590/x' || CAST(doc_id AS VARCHAR) AS doi, false AS ignored FROM documents")
def list_import(spark, sf):
    path = shared_folder(spark, "list")
    _entries(spark, sf).select(F.concat(F.lit("# a comment\nhttps://doi.org/"), "doi", F.lit(" # more\n"))).write.text(path)
    return importers.read_list(spark, path).select("doi", "ignored")


@query("""
    WITH r AS (SELECT doc_id, 'f' || CAST(doc_id % 3 AS VARCHAR) AS file, quality FROM labels),
    p AS (SELECT doc_id, quality, file, row_number() OVER (PARTITION BY doc_id % 97 ORDER BY file DESC, doc_id DESC) AS r FROM r)
    SELECT doc_id % 97 AS item, CAST(quality AS VARCHAR) AS value FROM p WHERE r = 1 AND (doc_id % 97) % 5 <> 0 AND quality = 1
""")
def supervisor_choices(spark, sf):
    """The last file wins, choices for other candidates than the item's are stale, and only candidates count."""
    rows = table(spark, sf, "labels").select((F.col("doc_id") % 97).alias("item"), F.col("quality").cast("string").alias("value"), F.concat(F.lit("f"), (F.col("doc_id") % 3).cast("string")).alias("file"), F.col("doc_id").alias("line"), F.lit("h").alias("candidates_hash"))
    items = spark.range(97).select(F.col("id").alias("item"), F.when(F.col("id") % 5 == 0, "old").otherwise("h").alias("candidates_hash"), F.array(F.lit("1")).alias("candidates"))
    return importers_choices(rows, items)


def importers_choices(rows: DataFrame, items: DataFrame) -> DataFrame:
    return voting.import_choices(rows, items, ["item"], "file", "line")[0].select("item", "value")


# ---- picks and texts -----------------------------------------------------------------


@query("SELECT o_orderkey FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1998")
def year_range(spark, sf):
    return table(spark, sf, "orders").where(F.year("o_orderdate").between(*years("1996-1998"))).select("o_orderkey")


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type NOT IN ('click', 'view') GROUP BY event_type")
def rejects_by_kind(spark, sf):
    return R.whitelisted(table(spark, sf, "events"), "event_type", ["click", "view"])[1]


@query("""
    WITH e AS (SELECT CAST(s_suppkey AS VARCHAR) AS entry FROM supplier UNION SELECT c_name FROM customer WHERE c_nationkey = 3 UNION SELECT 'nobody')
    SELECT 'kept' AS what, CAST(c_custkey AS VARCHAR) AS key FROM customer WHERE CAST(c_custkey AS VARCHAR) NOT IN (SELECT entry FROM e) AND c_name NOT IN (SELECT entry FROM e)
    UNION ALL SELECT 'unmatched', entry FROM e WHERE entry NOT IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer UNION SELECT c_name FROM customer)
""")
def exclusions(spark, sf):
    """Customers named in a list by key or name go; entries that name nobody are reported."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("key"), "c_name", "c_nationkey")
    entries = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("entry")).unionByName(c.where("c_nationkey = 3").select(F.col("c_name").alias("entry"))).unionByName(spark.createDataFrame([("nobody",)], "entry string")).distinct()
    kept, unmatched = R.excluded(c, entries, ["key", "c_name"])
    return kept.select(F.lit("kept").alias("what"), "key").unionByName(unmatched.select(F.lit("unmatched").alias("what"), F.col("entry").alias("key")))


LANGUAGES_SQL = "t AS (SELECT n_regionkey, n_nationkey, ['pt', 'en', 'es', 'fr'][1 + n_nationkey % 4] AS language, n_name AS text FROM nation)"


def _nation_texts(spark: SparkSession, sf: str) -> DataFrame:
    """(n_regionkey, texts): a region's nations as texts in four languages, in order of key."""
    language = F.element_at(F.array(*map(F.lit, ("pt", "en", "es", "fr"))), (F.col("n_nationkey") % 4 + 1).cast("int"))
    one = F.struct("n_nationkey", language.alias("language"), F.col("n_name").alias("text"), F.lit("own").alias("origin"))
    plain = lambda x: F.struct(x["language"].alias("language"), x["text"].alias("text"), x["origin"].alias("origin"))
    return table(spark, sf, "nation").groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list(one)), plain).alias("texts"))


@query(f"""
    WITH {LANGUAGES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY CASE language WHEN 'es' THEN 0 WHEN 'fr' THEN 1 ELSE 2 END, n_nationkey) AS r FROM t)
    SELECT n_regionkey, language, text FROM r WHERE r = 1
""")
def preferred_language_text(spark, sf):
    pick = T.preferred_text(F.col("texts"), ["es", "fr"])
    return _nation_texts(spark, sf).select("n_regionkey", pick["language"].alias("language"), pick["text"].alias("text"))


@query(f"""
    WITH {LANGUAGES_SQL}, f AS (SELECT n_regionkey, language, min_by(text, n_nationkey) AS text FROM t GROUP BY ALL),
    a AS (SELECT n_regionkey, max(text) FILTER (WHERE language = 'fr') AS fr, max(text) FILTER (WHERE language = 'en') AS en, max(text) FILTER (WHERE language = 'pt') AS pt FROM f GROUP BY n_regionkey),
    p AS (SELECT *, min_by(t.text, t.n_nationkey) AS first FROM a JOIN t USING (n_regionkey) GROUP BY ALL)
    SELECT DISTINCT n_regionkey, CASE WHEN fr IS NOT NULL THEN fr || '. ' || fr WHEN en IS NOT NULL THEN en || '. ' || en ELSE coalesce(fr, en, (SELECT min_by(x.text, x.n_nationkey) FROM t x WHERE x.n_regionkey = a.n_regionkey)) END AS text,
           CASE WHEN fr IS NOT NULL THEN 'abstract' WHEN en IS NOT NULL THEN 'reserve' ELSE 'title_only' END AS provenance FROM a
""")
def analysis_text_provenance(spark, sf):
    x = T.analysis_text(F.col("texts"), F.col("texts"), "fr", "en")
    return _nation_texts(spark, sf).select("n_regionkey", x["text"].alias("text"), x["provenance"].alias("provenance"))


@query(f"""
    WITH {LANGUAGES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY CASE language WHEN 'es' THEN 0 WHEN 'fr' THEN 1 ELSE 2 END, n_nationkey) AS r FROM t)
    SELECT n_regionkey, text AS title, text AS abstract, language FROM r WHERE r = 1
""")
def classification_text(spark, sf):
    x = C.classification_texts(F.col("texts"), F.col("texts"), ["es", "fr"])
    return _nation_texts(spark, sf).select("n_regionkey", x["title"].alias("title"), x["abstract"].alias("abstract"), x["language"].alias("language"))


@query("""
    WITH l AS (SELECT o_orderkey, CAST(1 + o_orderkey % 6 AS INTEGER) AS i, CAST(1 + o_custkey % 6 AS INTEGER) AS j FROM orders),
    n AS (SELECT o_orderkey, ['cc-by', 'cc-by-nc', 'cc0', 'other', 'cc-by-nc-nd', NULL][i] AS a, ['cc-by', 'cc-by-nc', 'cc0', 'other', 'cc-by-nc-nd', NULL][j] AS b FROM l),
    k AS (SELECT *, list_position(['cc0', 'cc-by', 'cc-by-sa', 'cc-by-nc', 'cc-by-nc-sa', 'cc-by-nd', 'cc-by-nc-nd', 'other'], a) AS ra, list_position(['cc0', 'cc-by', 'cc-by-sa', 'cc-by-nc', 'cc-by-nc-sa', 'cc-by-nd', 'cc-by-nc-nd', 'other'], b) AS rb FROM n)
    SELECT o_orderkey, a AS own, CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a WHEN ra >= rb THEN a ELSE b END AS both FROM k
""")
def licences(spark, sf):
    raw = F.array(*map(F.lit, ("CC_BY 4.0", "https://creativecommons.org/licenses/by-nc/4.0/", "publicdomain/zero", "all rights reserved", "cc-by-nc-nd", None)))
    o = table(spark, sf, "orders").select("o_orderkey", *(T.licence(F.element_at(raw, (F.col(c) % 6 + 1).cast("int"))).alias(n) for c, n in (("o_orderkey", "own"), ("o_custkey", "other"))))
    return o.select("o_orderkey", "own", T.more_restrictive(F.col("own"), F.col("other")).alias("both"))


@query("""
    WITH n AS (SELECT n_regionkey, count(*) AS n, min_by(n_name, n_nationkey) AS first FROM nation GROUP BY n_regionkey)
    SELECT n_regionkey, first || ', ' || upper(first[1]) || '.' || CASE WHEN n > 1 THEN '; +' || CAST(n - 1 AS VARCHAR) ELSE '' END AS short FROM n
""")
def short_author_names(spark, sf):
    one = F.struct("n_nationkey", F.col("n_name").alias("surname"), F.lower("n_name").alias("given"))
    people = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: F.struct(x["surname"].alias("surname"), x["given"].alias("given"))).alias("a"))
    return people.select("n_regionkey", T.short_authors(F.col("a")).alias("short"))


@query("SELECT doc_id, trim(regexp_replace(lower(regexp_replace(strip_accents(translate(text, '’‘`´“”–—‐‑‒―−ı', '             i')), '[^\\x00-\\x7F]', '', 'g')), '[^a-z0-9]+', ' ', 'g')) AS key FROM documents")
def text_keys(spark, sf):
    return table(spark, sf, "documents").select("doc_id", N.text_key(F.col("text")).alias("key"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS issn FROM part WHERE lower(p_brand) = 'brand#11'")
def journal_lookup(spark, sf):
    journals = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("issn"), F.col("p_brand").alias("acronym"), F.col("p_name").alias("title"))
    return importers.find_journals(journals, "BRAND#11").select("issn")


@query("SELECT p_partkey, p_name AS text FROM part")
def inverted_abstracts(spark, sf):
    """Names turned into maps from word to positions, and back."""
    words = F.split("p_name", " ")
    index = F.map_from_entries(F.transform(F.array_distinct(words), lambda w: F.struct(w, F.filter(F.transform(words, lambda x, i: F.when(x == w, i)), lambda i: i.isNotNull()))))
    return table(spark, sf, "part").select("p_partkey", T.inverted_abstract(index).alias("text"))


@query("""
    WITH d AS (SELECT o_orderkey, lpad(CAST(o_orderkey AS VARCHAR), 15, '0') AS d FROM orders),
    c AS (SELECT o_orderkey, d, (12 - list_reduce([CAST(0 AS BIGINT)] || list_transform(range(1, 16), lambda i: CAST(d[i] AS BIGINT)), lambda s, x: ((s + x) * 2) % 11) % 11) % 11 AS c FROM d)
    SELECT o_orderkey, CASE WHEN c = 10 THEN 'X' ELSE CAST(c AS VARCHAR) END = CAST(o_orderkey % 10 AS VARCHAR) AS valid FROM c
""")
def orcid_digits(spark, sf):
    d = F.lpad(F.col("o_orderkey").cast("string"), 15, "0")
    o = F.concat(F.substring(d, 1, 4), F.lit("-"), F.substring(d, 5, 4), F.lit("-"), F.substring(d, 9, 4), F.lit("-"), F.substring(d, 13, 3), (F.col("o_orderkey") % 10).cast("string"))
    return table(spark, sf, "orders").select("o_orderkey", T.orcid_is_valid(T.orcid(F.concat(F.lit("https://orcid.org/"), o))).alias("valid"))


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders")
def years_of_codes(spark, sf):
    code = F.concat(F.lit("S0104-6276"), F.year("o_orderdate").cast("string"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0"))
    return table(spark, sf, "orders").select("o_orderkey", T.year_of_pid(code).alias("year"))


@query("""
    WITH s AS (SELECT doc_id, regexp_extract_all(text, '\\p{L}+|[.!?:]') AS t FROM documents),
    w AS (SELECT unnest(list_transform(range(2, len(t) + 1), lambda i: {'w': t[i], 'b': t[i - 1]})) AS x FROM s)
    SELECT lower(x.w) AS word, CAST(sum(CAST(regexp_matches(x.w, '^\\p{Lu}') AS INT)) AS BIGINT) AS capitals, count(*) AS n FROM w
    WHERE x.w NOT IN ('.', '!', '?', ':') AND x.b NOT IN ('.', '!', '?', ':') GROUP BY 1
""")
def word_case(spark, sf):
    return T.case_counts(table(spark, sf, "documents"), "text")


# ---- counts and reports ------------------------------------------------------------------

ANSWERS = """
    a AS (SELECT CAST(doc_id AS VARCHAR) AS doc, 'quality' AS variable, 'yes_no' AS kind, CASE quality WHEN 1 THEN 'true' ELSE 'false' END AS value,
                 CASE WHEN quality = 0 THEN 'waived' WHEN doc_id % 3 = 0 THEN 'approximate' ELSE 'literal' END AS status FROM labels
          UNION ALL SELECT CAST(doc_id AS VARCHAR), 'parts', 'choices', ['[]', '["a"]', '["a","b"]'][CAST(1 + doc_id % 3 AS INTEGER)], CASE WHEN toxic = 1 THEN 'absent' ELSE 'literal' END FROM labels),
    each AS (SELECT doc, variable, kind, status, unnest(CASE kind WHEN 'choices' THEN from_json(value, '["VARCHAR"]') ELSE [value] END) AS value FROM a)
"""


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("doc"), "doc_id", "quality", "toxic")
    status = F.when(F.col("quality") == 0, "waived").when(F.col("doc_id") % 3 == 0, "approximate").otherwise("literal")
    one = rows.select("doc", F.lit("quality").alias("variable"), F.lit("yes_no").alias("kind"), F.when(F.col("quality") == 1, "true").otherwise("false").alias("value"), status.alias("status"))
    sets = F.array(*map(F.lit, ("[]", '["a"]', '["a","b"]')))
    two = rows.select("doc", F.lit("parts").alias("variable"), F.lit("choices").alias("kind"), F.element_at(sets, (F.col("doc_id") % 3 + 1).cast("int")).alias("value"), F.when(F.col("toxic") == 1, "absent").otherwise("literal").alias("status"))
    return one.unionByName(two)


def _answered(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc"), "lang")


@query(f"""
    WITH {ANSWERS}, p AS (SELECT variable, count(*) AS n, round_even(count(*) FILTER (WHERE value IN ('false', '[]')) / count(*), 4) AS no_answer, count(*) FILTER (WHERE status <> 'waived') AS q FROM a GROUP BY variable),
    s AS (SELECT variable, status, count(*) AS c FROM a WHERE status <> 'waived' GROUP BY ALL)
    SELECT variable, n, no_answer, status, round_even(c / q, 4) AS share FROM p LEFT JOIN s USING (variable)
""")
def classification_summary(spark, sf):
    return C.classification_summary(_answers(spark, sf))


@query(f"WITH {ANSWERS} SELECT variable, value, count(*) AS n FROM each GROUP BY ALL")
def answer_counts(spark, sf):
    return C.value_counts(_answers(spark, sf))


CELLS = "v AS (SELECT doc, value FROM each WHERE variable = 'parts'), c AS (SELECT CAST(doc_id AS VARCHAR) AS doc, lang, coalesce(value, 'unclassified') AS value FROM documents LEFT JOIN v ON v.doc = CAST(doc_id AS VARCHAR))"


@query(f"WITH {ANSWERS}, {CELLS} SELECT lang, value, count(DISTINCT doc) AS n FROM c GROUP BY ALL")
def answer_cross_tab(spark, sf):
    return C.cross_tab(_answered(spark, sf), _answers(spark, sf), "parts", "lang")


@query(f"WITH {ANSWERS}, {CELLS} SELECT DISTINCT doc FROM c WHERE lang = 'fr' AND value = 'b'")
def answer_cell(spark, sf):
    return C.cell_documents(_answered(spark, sf), _answers(spark, sf), "parts", "lang", "fr", "b").distinct()


@query("""
    SELECT stage, count(*) AS n, sum(CAST(CAST(toxic AS VARCHAR) = CAST(quality AS VARCHAR) AS INT))::BIGINT AS right FROM (SELECT *, CASE WHEN doc_id % 2 = 0 THEN 'majority' ELSE 'unanimous' END AS stage FROM labels) GROUP BY stage
""")
def stage_agreement(spark, sf):
    rows = table(spark, sf, "labels").select(F.col("doc_id").alias("doc"), F.lit("v").alias("variable"), F.col("toxic").cast("string").alias("toxic"), F.col("quality").cast("string").alias("quality"), F.when(F.col("doc_id") % 2 == 0, "majority").otherwise("unanimous").alias("stage"))
    return C.agreement_by_stage(rows.withColumnRenamed("toxic", "value"), rows.select("doc", "variable", F.col("quality").alias("value")))


@query("""
    WITH v AS (SELECT doc_id, 'm' || CAST(doc_id % 2 AS VARCHAR) AS member, toxic AS one, CASE WHEN doc_id % 3 = 0 THEN 1 - toxic ELSE toxic END AS two, quality AS ref, doc_id % 3 = 0 AS revised FROM labels)
    SELECT member, count(*) AS votes, count(*) FILTER (WHERE revised) AS changed, count(*) FILTER (WHERE revised AND one <> ref AND two = ref) AS towards, count(*) FILTER (WHERE revised AND one = ref AND two <> ref) AS against FROM v GROUP BY member
""")
def moved_votes(spark, sf):
    own = table(spark, sf, "labels").select(F.col("doc_id").alias("doc"), F.lit("v").alias("variable"), F.concat(F.lit("m"), (F.col("doc_id") % 2).cast("string")).alias("member"), "toxic", "quality", (F.col("doc_id") % 3 == 0).alias("revised"))
    first = own.select("doc", "variable", "member", F.lit(1).alias("round"), F.col("toxic").alias("value"), F.lit(False).alias("revised"))
    second = own.select("doc", "variable", "member", F.lit(2).alias("round"), F.when(F.col("revised"), 1 - F.col("toxic")).otherwise(F.col("toxic")).alias("value"), "revised")
    return C.votes_moved(first.unionByName(second), own.select("doc", "variable", F.col("quality").alias("value")))


@query("""
    WITH t AS (SELECT p_type AS g, p_brand AS term, count(*) AS weight FROM part GROUP BY ALL), s AS (SELECT p_type AS g, substr(p_type, 1, 3) AS macro, count(*) AS size FROM part GROUP BY ALL),
    m AS (SELECT macro, term, sum(weight * size) AS weight FROM t JOIN s USING (g) GROUP BY ALL)
    SELECT macro, term, CAST(weight AS BIGINT) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY macro ORDER BY weight DESC, term) AS r FROM m) WHERE r <= 5
""")
def macro_terms(spark, sf):
    p = table(spark, sf, "part")
    weights = p.groupBy(F.col("p_type").alias("g"), F.col("p_brand").alias("term")).agg(F.count(F.lit(1)).alias("weight"))
    sizes = p.groupBy(F.col("p_type").alias("g"), F.substring("p_type", 1, 3).alias("macro")).agg(F.count(F.lit(1)).alias("size"))
    return terms.macro_keywords(weights, sizes, "g", "macro", 5).select("macro", "term", "weight")


@query("SELECT n_name AS name, CAST(row_number() OVER (ORDER BY n DESC, n_name) - 1 AS INTEGER) AS place FROM (SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name)")
def dictionary_order(spark, sf):
    """Positions in the dictionary of a published table, by falling count."""
    rows = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    names = sinks.columnar(rows, ["c_custkey"], ["n_name"])["dictionaries"]["n_name"]
    return spark.createDataFrame([(name, i) for i, name in enumerate(names)], "name string, place int")


@query("""
    WITH g AS (SELECT p_type AS g, count(*) AS size FROM part GROUP BY p_type), m AS (SELECT * FROM g WHERE length(g) % 2 = 0)
    SELECT g AS "group", CAST(row_number() OVER (ORDER BY g) AS INTEGER) AS id FROM m UNION ALL
    SELECT g, CAST(999 + row_number() OVER (ORDER BY size DESC, g) AS INTEGER) FROM g WHERE length(g) % 2 = 1
""")
def stable_topic_numbers(spark, sf):
    """Matched groups keep their numbers, the others get new ones by falling size."""
    g = table(spark, sf, "part").groupBy(F.col("p_type").alias("group")).agg(F.count(F.lit(1)).alias("size"))
    matched = R.numbered(g.where(F.length("group") % 2 == 0), [F.col("group")], "id", 1)
    return R.stable_numbers(g, matched, 1000)


@query("""
    WITH s AS (SELECT l_orderkey, l_returnflag, l_linenumber, ['literal', 'approximate', 'waived', 'absent'][1 + l_linenumber % 4] AS status FROM lineitem)
    SELECT l_orderkey, l_returnflag, status, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY list_position(['literal', 'approximate', 'waived', 'absent'], status), l_linenumber) AS r FROM s) WHERE r = 1
""")
def best_evidence(spark, sf):
    status = F.element_at(F.array(*map(F.lit, voting.STATUSES)), (F.col("l_linenumber") % 4 + 1).cast("int"))
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", status.alias("status"), "l_linenumber")
    return voting.best_evidence(rows, ["l_orderkey"], "l_returnflag", "status", "l_linenumber")


@query("SELECT l_orderkey, l_returnflag, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY CASE WHEN l_linestatus = 'O' THEN 0 ELSE 1 END, l_linenumber) AS r FROM lineitem) WHERE r = 1")
def one_text_per_language(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("right", F.col("l_linestatus") == "O")
    return R.one_per_language(rows, ["l_orderkey"], "l_returnflag", "right", "l_linenumber").select("l_orderkey", "l_returnflag", "l_linenumber")


@query("""
    WITH n AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS hits FROM labels JOIN documents USING (doc_id) GROUP BY source)
    SELECT source, n, hits, round(hits / n, 9) AS precision, size FROM n JOIN (SELECT source, count(*) AS size FROM documents GROUP BY source) USING (source)
""")
def stratum_precision(spark, sf):
    d = table(spark, sf, "documents")
    judged = table(spark, sf, "labels").join(d, "doc_id").select("source", (F.col("quality") == 1).alias("right"))
    out = S.precision_by_stratum(judged, d.groupBy("source").agg(F.count(F.lit(1)).alias("size")), "source", "right")
    return out.select("source", "n", "hits", F.round("precision", 9).alias("precision"), "size")


@query("SELECT o_orderkey, CAST(len(list_filter([1, 2, 5, 10, 20, 50, 100, 200, 500], lambda b: o_totalprice / 1000 >= b)) AS INTEGER) AS class, round(o_totalprice / 500000 * 2 - 1, 9) AS x FROM orders")
def colour_classes(spark, sf):
    value = F.col("o_totalprice") / 1000
    return table(spark, sf, "orders").select("o_orderkey", cube.class_of(value, cube.log_breaks(500)).alias("class"), F.round(cube.affine(F.col("o_totalprice"), 0.0, 500000.0), 9).alias("x"))


@query("""
    WITH m AS (SELECT DISTINCT o_custkey % 200 AS node, o_orderkey AS doc FROM orders), g AS (SELECT node, CAST(node % 6 - 1 AS INTEGER) AS community FROM (SELECT DISTINCT node FROM m)),
    t AS (SELECT o_orderkey AS doc, CAST(o_orderkey % 11 - 1 AS INTEGER) AS topic, CAST(o_orderkey % 3 AS INTEGER) AS macro FROM orders),
    d AS (SELECT DISTINCT community, doc FROM g JOIN m USING (node) WHERE community >= 0), p AS (SELECT * FROM d JOIN t USING (doc) WHERE topic >= 0),
    k AS (SELECT community, topic, count(*) AS k FROM p GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY k DESC, topic) AS r FROM k),
    a AS (SELECT community, macro, count(*) AS k FROM p GROUP BY ALL), b AS (SELECT community, macro FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY k DESC, macro) AS r FROM a) WHERE r = 1)
    SELECT s.community, s.n, e.documents, b.macro, (SELECT list(topic ORDER BY r) FROM r WHERE r.community = s.community AND r <= 3) AS topics,
           (SELECT string_agg('t' || CAST(topic AS VARCHAR), ' · ' ORDER BY r) FROM r WHERE r.community = s.community AND r <= 2) AS label
    FROM (SELECT community, count(*) AS n FROM g WHERE community >= 0 GROUP BY community) s JOIN (SELECT community, count(*) AS documents FROM d GROUP BY community) e USING (community) LEFT JOIN b USING (community)
""")
def community_report(spark, sf):
    o = table(spark, sf, "orders")
    members = o.select((F.col("o_custkey") % 200).alias("node"), F.col("o_orderkey").alias("doc")).distinct()
    groups = members.select("node").distinct().withColumn("community", (F.col("node") % 6 - 1).cast("int"))
    topics = o.select(F.col("o_orderkey").alias("doc"), (F.col("o_orderkey") % 11 - 1).cast("int").alias("topic"), (F.col("o_orderkey") % 3).cast("int").alias("macro"))
    labels = spark.range(10).select(F.col("id").cast("int").alias("topic"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("label"))
    return graph.community_summary(groups, members, topics, labels)


@query("""
    WITH c AS (SELECT l_partkey AS work, CAST(year(l_shipdate) AS INTEGER) AS year, count(*) AS k FROM lineitem GROUP BY ALL),
    t AS (SELECT work, sum(k) AS n, max(k) AS top, min(CASE WHEN k > 1 THEN year END) AS twice FROM c GROUP BY work), m AS (SELECT work, min(year) AS year FROM c JOIN t USING (work) WHERE k = top GROUP BY work)
    SELECT work, CASE WHEN top >= 0.3 * n THEN m.year ELSE twice END AS year FROM t JOIN m USING (work)
""")
def majority_years(spark, sf):
    return citations.majority_year(table(spark, sf, "lineitem").select(F.col("l_partkey").alias("work"), F.year("l_shipdate").alias("year")), "work", "year")


# ---- resolution ------------------------------------------------------------------------------


@query("""
    WITH d AS (SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS doi, o_orderpriority = '1-URGENT' AS sure, count(*) OVER (PARTITION BY o_custkey) AS n, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') OVER (PARTITION BY o_custkey) AS c FROM orders)
    SELECT o_orderkey AS id, CASE WHEN n > 1 AND c = 1 AND NOT sure THEN NULL ELSE doi END AS doi FROM d
""")
def repeated_identifiers(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("doi"), (F.col("o_orderpriority") == "1-URGENT").alias("confirmed"))
    return resolve.repeated_doi(o).select("id", "doi")


@query("""
    WITH f AS (SELECT o_custkey AS c, min(o_orderkey) AS id FROM orders GROUP BY 1), o AS (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS p, 's' || CAST(o_orderkey % 4 AS VARCHAR) AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders),
    g AS (SELECT o_custkey AS c, s, min(r) AS r FROM o GROUP BY ALL)
    SELECT CAST(f.id AS VARCHAR) AS id, (SELECT min_by(p, r) FROM o WHERE o_custkey = f.c AND p IS NOT NULL) AS doi, (SELECT list(s ORDER BY r) FROM g WHERE g.c = f.c) AS origins FROM f
""")
def merged_documents(spark, sf):
    """Orders of a customer as one document: the first value there is of each column, origins in order of appearance."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("id"), "o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).alias("doi"), F.array(F.concat(F.lit("s"), (F.col("o_orderkey") % 4).cast("string"))).alias("origins"))
    kept = o.join(o.groupBy("o_custkey").agg(F.min("o_orderkey").cast("string").alias("kept")), "o_custkey").select("id", "kept", "o_orderkey")
    return resolve.merge(o.select("id", "doi", "origins"), kept, F.col("o_orderkey"))


@query("""
    SELECT CAST(c_custkey AS VARCHAR) AS doc, 'w' || CAST(c_custkey AS VARCHAR) AS work, CAST([1, 2, 3, 4][CAST(1 + c_custkey % 4 AS INTEGER)] AS INTEGER) AS step FROM customer
""")
def match_cascade(spark, sf):
    """Customers as documents and as works: a quarter each meets by doi, by the code in an address, by the doi of the code, by title and year."""
    key = F.col("c_custkey").cast("string")
    kind = F.col("c_custkey") % 4
    code = F.concat(F.lit("S0104-62762020"), F.lpad(key, 9, "0"))
    c = table(spark, sf, "customer")
    docs = c.select(key.alias("id"), F.when(kind == 0, F.concat(F.lit("10.1/"), key)).alias("doi"), F.when(kind.isin(1, 2), code).alias("pid"), F.lit(2020).alias("year"), F.array(F.concat(F.lit("Title of "), "c_name")).alias("titles"))
    works = c.select(F.concat(F.lit("w"), key).alias("id"), F.when(kind == 0, F.concat(F.lit("10.1/"), key)).when(kind == 2, F.concat(F.lit("10.1590/"), F.lower(code))).alias("doi"), F.when(kind == 1, F.array(F.concat(F.lit("https://x/"), code))).alias("urls"), F.lit(2020).alias("year"), F.concat(F.lit("title OF "), "c_name").alias("title"))
    return resolve.match_works(docs, works)


@query("""
    SELECT c_custkey AS entry, CASE c_custkey % 3 WHEN 0 THEN 'p' WHEN 1 THEN 'd' ELSE 'w' END || CAST(c_custkey AS VARCHAR) AS record, CAST(1 + c_custkey % 3 AS INTEGER) AS step FROM customer WHERE c_nationkey <> 7
""")
def hydrated_entries(spark, sf):
    c = table(spark, sf, "customer").withColumn("k", F.col("c_custkey").cast("string"))
    entries = c.select(F.col("c_custkey").alias("entry"), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("P"), "k")).alias("pid"), F.concat(F.lit("10.1/"), "k").alias("doi"))
    there = c.where("c_nationkey <> 7")
    records = there.where("c_custkey % 3 < 2").select(F.concat(F.when(F.col("c_custkey") % 3 == 0, "p").otherwise("d"), "k").alias("id"), F.concat(F.lit("p"), "k").alias("pid"), F.concat(F.lit("10.1/"), "k").alias("doi"))
    works = there.where("c_custkey % 3 = 2").select(F.concat(F.lit("w"), "k").alias("id"), F.concat(F.lit("10.1/"), "k").alias("doi"))
    return resolve.hydrate(entries, records, works)[0]


@query("SELECT CAST(s_suppkey AS VARCHAR) AS mention, min(CAST(s_suppkey AS VARCHAR)) OVER (PARTITION BY s_nationkey) AS person FROM supplier")
def people_of_suppliers(spark, sf):
    """Suppliers as mentions of one person a nation: half of them by a short spelling that the full name holds."""
    letters = F.translate(F.lpad(F.col("s_nationkey").cast("string"), 2, "0"), "0123456789", "bcdfghjklm")
    name = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("Ana Maria So"), letters)).otherwise(F.concat(F.lit("Ana So"), letters))
    m = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("mention"), name.alias("name"), F.lit(None).cast("string").alias("source_id"), F.lit(None).cast("string").alias("orcid"), F.array(F.col("s_nationkey").cast("string")).alias("context"))
    return resolve.identify_people(m)


@query("""
    WITH k AS (SELECT c_nationkey, count(*) FILTER (WHERE c_custkey % 2 = 0) AS n FROM customer GROUP BY 1)
    SELECT c_custkey AS link, CASE WHEN c_custkey % 2 = 0 THEN 'author' WHEN n >= 2 THEN 'learned' ELSE 'index' END AS level, 'I' || CAST(c_nationkey AS VARCHAR) AS institution FROM customer JOIN k USING (c_nationkey)
""")
def institution_levels(spark, sf):
    """Customers as affiliations with a university of their nation, which another source names for every second one."""
    nations = table(spark, sf, "nation")
    universities = nations.select(F.concat(F.lit("I"), F.col("n_nationkey").cast("string")).alias("institution"), F.concat(F.lit("Universidade "), "n_name").alias("name"), F.lit("education").alias("kind"))
    index = I.registry(universities, {})
    links = table(spark, sf, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    own = F.when(F.col("c_custkey") % 2 == 0, F.array(F.concat(F.lit("I"), F.col("c_nationkey").cast("string"))))
    rows = links.select(F.col("c_custkey").alias("link"), F.concat(F.lit("Univ. "), F.initcap("n_name")).alias("text"), F.lit(None).cast("string").alias("country"), own.alias("author"), own.alias("work"))
    return I.match_affiliations(rows, index).select("link", "level", "institution")


@query("SELECT s_suppkey, CAST(CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE 0 END AS INTEGER) AS first, CASE WHEN s_suppkey % 3 = 1 THEN NULL ELSE CAST(CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE 1 END AS INTEGER) END AS second FROM supplier")
def aligned_authors(spark, sf):
    """Two authors against another source's: swapped, with a stranger, in place."""
    kind = F.col("s_suppkey") % 3
    a = F.array(F.lit("Ana Souza"), F.lit("Bruno Lima"))
    b = F.when(kind == 0, F.array(F.lit("B. Lima"), F.lit("Ana P. Souza"))).when(kind == 1, F.array(F.lit("Ana Souza"), F.lit("Carla Dias"))).otherwise(F.array(F.lit("A. Souza"), F.lit("Bruno de Lima")))
    s = table(spark, sf, "supplier").select("s_suppkey", a.alias("a"), b.alias("b")).select("s_suppkey", resolve.align_authors(F.col("a"), F.col("b")).alias("x"))
    return s.select("s_suppkey", F.col("x")[0].alias("first"), F.col("x")[1].alias("second"))


@query("""
    SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'N' || CAST(c_nationkey AS VARCHAR) END AS country, CASE WHEN c_custkey % 3 = 0 THEN 'SP' END AS state, CASE WHEN c_custkey % 3 = 0 THEN 'Campinas' ELSE 'Campinas, X' END AS city FROM customer
""")
def places_of_texts(spark, sf):
    """Countries by name inside a text, and cities with a state's code behind them."""
    nations = table(spark, sf, "nation")
    names = nations.select(F.col("n_name").alias("name"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("code"))
    c = table(spark, sf, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("Somewhere, "), F.initcap("n_name"))).otherwise("Nowhere").alias("t"), F.when(F.col("c_custkey") % 3 == 0, "Campinas - SP").otherwise("Campinas, X").alias("place"))
    where = places.split_city_state(F.col("place"), ["SP", "RJ"])
    return c.join(places.countries(c, "t", names), "t", "left").select("c_custkey", "country", where["state"].alias("state"), where["city"].alias("city"))


@query("""
    WITH l AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'A' END AS s, CASE WHEN o_orderkey % 3 = 0 THEN 'A' WHEN o_orderkey % 3 = 1 THEN 'B' END AS i, o_orderpriority = '1-URGENT' AS t, o_orderstatus = 'F' AS c FROM orders)
    SELECT o_orderkey, CASE WHEN s IS NOT NULL AND i IS NOT NULL AND s <> i THEN CASE WHEN t THEN 'T' ELSE s END ELSE coalesce(s, i, CASE WHEN t THEN 'T' END, CASE WHEN c THEN 'C' END) END AS state FROM l
""")
def decided_states(spark, sf):
    k = F.col("o_orderkey")
    links = table(spark, sf, "orders").select("o_orderkey", F.when(k % 2 == 0, "A").alias("state_source"), F.when(k % 3 == 0, "A").when(k % 3 == 1, "B").alias("state_import"), F.col("o_orderpriority").alias("text"), F.col("o_orderstatus").alias("city"))
    learned, city = spark.createDataFrame([("1-URGENT", "T")], "text string, state string"), spark.createDataFrame([("F", "C")], "city string, state string")
    return counting.state_ladder(links, learned, city).select("o_orderkey", "state")


# ---- votes and jobs ----------------------------------------------------------------------------


@query("""
    SELECT doc_id, v.variable, v.value FROM (SELECT doc_id, unnest([{'variable': 'm:x', 'value': CASE WHEN quality = 1 THEN 'true' ELSE 'false' END}, {'variable': 'm:y', 'value': CASE WHEN toxic = 1 THEN 'true' ELSE 'false' END}, {'variable': 's', 'value': CAST(quality AS VARCHAR)}]) AS v FROM labels)
""")
def expanded_choices(spark, sf):
    one = lambda c, o: F.when(F.col(c) == 1, F.array(F.lit(o))).otherwise(F.array().cast("array<string>"))
    rows = table(spark, sf, "labels")
    many = rows.select("doc_id", F.lit("r").alias("rater"), F.lit("m").alias("variable"), F.to_json(F.concat(one("quality", "x"), one("toxic", "y"))).alias("value"))
    single = rows.select("doc_id", F.lit("r").alias("rater"), F.lit("s").alias("variable"), F.col("quality").cast("string").alias("value"))
    return S.expand_choices(many.unionByName(single), ["doc_id"], "rater", "variable", "value", {"m": ["x", "y"]}).select("doc_id", "variable", "value")


@query("SELECT doc_id, 'quality' AS variable, CAST(quality AS VARCHAR) AS value FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 'toxic', CAST(toxic AS VARCHAR) FROM labels")
def codings_of_the_codebook(spark, sf):
    rows = table(spark, sf, "labels").select("doc_id", F.expr("stack(2, 'quality', CAST(quality AS STRING), 'toxic', CAST(toxic AS STRING)) AS (variable, value)"))
    return S.valid_codings(rows, {"quality": ["1"], "toxic": None}, ["doc_id"], "variable", "value")


@query("SELECT doc_id, coalesce(n.quality, o.quality) AS quality FROM (SELECT doc_id, quality FROM labels) o FULL JOIN (SELECT doc_id, 1 - quality AS quality FROM labels WHERE doc_id % 2 = 0) n USING (doc_id)")
def partial_run(spark, sf):
    """A run over half of the keys updates them and leaves the others."""
    old = table(spark, sf, "labels").select("doc_id", "quality")
    return voting.keep_or_replace(old, old.where("doc_id % 2 = 0").select("doc_id", (1 - F.col("quality")).alias("quality")), "doc_id")


@query("""
    WITH i AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE CAST(quality AS VARCHAR) END AS one, CASE WHEN doc_id % 8 = 0 THEN 'two' END AS two, CASE WHEN doc_id % 5 = 0 THEN 'sup' END AS sup FROM labels)
    SELECT doc_id, coalesce(sup, one, two) AS value, CASE WHEN sup IS NOT NULL THEN 'supervisor' WHEN one IS NOT NULL THEN 'majority' WHEN two IS NOT NULL THEN 'deliberation' ELSE 'no_majority' END AS stage, coalesce(sup IS NOT NULL AND coalesce(one, two) IS NOT NULL, false) AS flipped FROM i
""")
def jury_decisions(spark, sf):
    d = table(spark, sf, "labels")
    one = d.select("doc_id", F.when(F.col("doc_id") % 4 != 0, F.col("quality").cast("string")).alias("value"), F.when(F.col("doc_id") % 4 == 0, "undecided").otherwise("majority").alias("stage"), F.lit("h").alias("candidates"))
    two = d.where("doc_id % 4 = 0").select("doc_id", F.when(F.col("doc_id") % 8 == 0, "two").alias("value"), F.when(F.col("doc_id") % 8 == 0, "majority").otherwise("undecided").alias("stage"))
    sup = d.where("doc_id % 5 = 0").select("doc_id", F.lit("sup").alias("value"), F.lit("h").alias("candidates"))
    return voting.final_decisions(one, two, sup, ["doc_id"])


JOBS = "e AS (SELECT event_type AS job, event_id AS seq, CASE event_id % 5 WHEN 0 THEN 'started' WHEN 4 THEN 'finished' ELSE 'progress' END AS kind, CASE WHEN event_id % 3 = 0 THEN event_id END AS done, CAST(100000000 AS BIGINT) AS total, ts AS at FROM events)"


def _job_events(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id") % 5
    return table(spark, sf, "events").select(F.col("event_type").alias("job"), F.col("event_id").alias("seq"), F.when(k == 0, "started").when(k == 4, "finished").otherwise("progress").alias("kind"), F.when(F.col("event_id") % 3 == 0, F.col("event_id")).alias("done"), F.lit(100_000_000).cast("long").alias("total"), F.lit(None).cast("string").alias("message"), F.col("ts").alias("at"))


@query(f"WITH {JOBS} SELECT job, max_by(kind, seq) FILTER (WHERE kind <> 'progress') AS status, max_by(done, seq) FILTER (WHERE done IS NOT NULL) AS done, max(seq) AS last_seq FROM e GROUP BY job")
def job_states(spark, sf):
    return jobs.state(_job_events(spark, sf)).select("job", "status", "done", "last_seq")


@query(f"WITH {JOBS} SELECT seq, kind FROM e WHERE job = 'click' AND seq > 500")
def job_events_since(spark, sf):
    return jobs.since(_job_events(spark, sf), "click", 500).select("seq", "kind")


# ---- records -----------------------------------------------------------------------------------


def _raw_records(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as JSON records of a collection."""
    key = F.col("c_custkey").cast("string")
    code = F.concat(F.lit("S0104-62762020"), F.lpad(key, 9, "0"))
    title = lambda lang: F.struct(F.lit(lang).alias("language"), F.concat(F.lit("<b>Of</b>  "), "c_name").alias("text"))
    person = lambda n: F.struct(F.lit(n).alias("given"), F.col("c_mktsegment").alias("surname"))
    reference = F.struct(F.concat(F.lit("R"), key).alias("title"), F.lit("1999").alias("year"), F.array(*(person(n) for n in "abcde")).alias("authors"))
    record = F.struct(code.alias("code"), F.concat(F.lit("https://doi.org/10.1590/C"), key, F.lit(".")).alias("doi"), F.lit("no year").alias("year"), F.lit("en").alias("language"), F.lit("dropped").alias("secret"), F.array(title("en"), title("en"), title("pt")).alias("titles"), F.array(reference, reference).alias("references"))
    return table(spark, sf, "customer").select(F.to_json(record).alias("j"))


@query("""
    SELECT 'S0104-62762020' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS id, '10.1590/c' || CAST(c_custkey AS VARCHAR) AS doi, CAST(2020 AS INTEGER) AS year, CAST(2 AS INTEGER) AS n_titles, 'Of ' || c_name AS title FROM customer
""")
def record_documents(spark, sf):
    d = records.documents(_raw_records(spark, sf), "j", "first")
    return d.select("id", "doi", "year", F.size("titles").alias("n_titles"), F.col("titles")[0]["text"].alias("title"))


@query("""
    SELECT 'S0104-62762020' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS doc, CAST(p AS INTEGER) AS position, 'R' || CAST(c_custkey AS VARCHAR) AS title, CAST(1999 AS INTEGER) AS year, CAST(3 AS INTEGER) AS n_authors FROM customer, (SELECT unnest([1, 2]) AS p)
""")
def record_references(spark, sf):
    return records.references(_raw_records(spark, sf), "j").select("doc", "position", "title", "year", F.size("surnames").alias("n_authors"))


@query("SELECT 'W' || CAST(s_suppkey AS VARCHAR) AS id, 'a ' || s_name || ' a' AS abstract, 'journal' AS journal, 'cc-by' AS licence FROM supplier")
def record_works(spark, sf):
    index = F.create_map(F.lit("a"), F.array(F.lit(0), F.lit(2)), F.col("s_name"), F.array(F.lit(1)))
    place = lambda source, issn, licence: F.struct(F.lit(source).alias("source"), issn.alias("issn"), F.lit(licence).alias("licence"))
    none = F.array().cast("array<string>")
    work = F.struct(F.concat(F.lit("W"), F.col("s_suppkey").cast("string")).alias("id"), index.alias("abstract_index"), F.array(place("repository", none, "cc0"), place("journal", F.array(F.lit("1234-5678")), "CC-BY 4.0")).alias("locations"))
    raw = table(spark, sf, "supplier").select(F.to_json(work).alias("j"))
    return records.works(raw, "j").select("id", "abstract", "journal", "licence")


@query("""
    SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'own' WHEN o_orderkey % 3 = 0 THEN 'found' END AS doi, CASE WHEN o_orderkey % 3 = 0 THEN 'cc-by-nc' ELSE 'cc-by' END AS licence FROM orders
""")
def enriched_documents(spark, sf):
    """Only nulls are filled from the matched work, and the licence is the more restrictive one."""
    key = F.col("o_orderkey")
    docs = table(spark, sf, "orders").select(key.cast("string").alias("id"), F.when(key % 2 == 0, "own").alias("doi"), F.lit(None).cast("string").alias("work"), F.lit("cc-by").alias("licence"), key)
    matches = docs.where(key % 3 == 0).select(F.col("id").alias("doc"), F.concat(F.lit("W"), "id").alias("work"), F.lit(1).alias("step"))
    found = docs.select(F.concat(F.lit("W"), "id").alias("id"), F.lit("found").alias("doi"), F.lit(1).alias("citations"), F.lit("cc-by-nc").alias("licence"), F.lit(None).cast("string").alias("url"))
    return records.enrich(docs.drop("o_orderkey"), matches, found).select("id", "doi", "licence")


@query("SELECT CAST(c_custkey AS VARCHAR) AS key, CAST(row_number() OVER (ORDER BY c_mktsegment, c_custkey) AS INTEGER) AS place FROM customer")
def ordered_table(spark, sf):
    """A table written in total order, by the place its rows have in the file."""
    path = shared_folder(spark, "ordered")
    sinks.write_table(table(spark, sf, "customer").select("c_mktsegment", "c_custkey"), path, ["c_mktsegment"], files=1)
    own = spark.read.parquet(path).select("c_custkey", F.monotonically_increasing_id().alias("at"))
    return R.numbered(own, [F.col("at")], "place", 1).select(F.col("c_custkey").cast("string").alias("key"), "place")


@query("""
    WITH k AS (SELECT p_brand, lower(regexp_replace(p_type, '[^A-Za-z0-9]+', ' ', 'g')) AS key, p_type, p_partkey FROM part)
    SELECT key, count(*) AS links, count(DISTINCT p_brand) AS documents, count(DISTINCT p_type) AS spellings, min(p_type) AS text FROM k GROUP BY key
""")
def open_affiliations(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_type").alias("text"), F.col("p_brand").alias("doc"), F.lit("BR").alias("country"))
    return resolve.review_groups(rows, "text", "doc", "country").select("key", "links", "documents", "spellings", "text")


@query("SELECT doc_id, 'ra' AS rater_a, 'rb' AS rater_b, quality = toxic AS same, true AS circular FROM labels")
def circular_pairs(spark, sf):
    """Two raters of one family, whose agreement says little."""
    rows = table(spark, sf, "labels").select("doc_id", F.expr("stack(2, 'ra', quality, 'rb', toxic) AS (rater, value)"))
    pairs = S.circular(S.rater_pairs(rows, ["doc_id"], "rater", "value"), {"ra": "f", "rb": "f"})
    return pairs.select("doc_id", "rater_a", "rater_b", (F.col("a") == F.col("b")).alias("same"), "circular")


@query("SELECT doc_id FROM labels WHERE doc_id % 3 <> 0")
def complete_sheets(spark, sf):
    rows = table(spark, sf, "labels").select("doc_id", F.expr("stack(2, 'quality', quality, 'toxic', toxic) AS (variable, value)")).where("NOT (variable = 'toxic' AND doc_id % 3 = 0)")
    return S.complete_sheets(rows, ["quality", "toxic"], ["doc_id"], "variable")


# ---- joins in time and ranges, SQL that users may run ------------------------------------------------


@query("""
    WITH v AS (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY ALL)
    SELECT c.event_id, v.event_id AS before FROM (SELECT * FROM events WHERE event_type = 'click') c ASOF LEFT JOIN v ON c.user_id = v.user_id AND c.ts >= v.ts
""")
def last_view_before_click(spark, sf):
    e = table(spark, sf, "events")
    views = e.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("before"))
    return R.as_of(e.where("event_type = 'click'").select("user_id", "ts", "event_id"), views, ["user_id"], "ts", ["before"]).select("event_id", "before")


@query("SELECT o_orderkey, s_suppkey FROM orders JOIN supplier ON o_totalprice BETWEEN s_acctbal * 10 AND s_acctbal * 10 + 5000")
def orders_in_ranges(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", (F.col("s_acctbal") * 10).alias("low"), (F.col("s_acctbal") * 10 + 5000).alias("high"))
    return R.within(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", s, "low", "high", 5000.0).select("o_orderkey", "s_suppkey")


@query("SELECT c_mktsegment AS segment, min(c_nationkey) AS first, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 0 ORDER BY 3 DESC, 1")
def grouped_by_ordinals(spark, sf):
    table(spark, sf, "customer").createOrReplaceTempView("customer_of_query")
    return spark.sql("SELECT c_mktsegment AS segment, any_value(first) AS first, sum(n) AS n FROM (SELECT c_mktsegment, min(c_nationkey) OVER (PARTITION BY c_mktsegment) AS first, 1 AS n FROM customer_of_query) GROUP BY 1 HAVING sum(n) > 0 ORDER BY 3 DESC, 1")


@query("SELECT coalesce(s_nationkey, c_nationkey) AS nation, coalesce(ns, 0) AS suppliers, coalesce(nc, 0) AS customers FROM (SELECT s_nationkey, count(*) AS ns FROM supplier WHERE s_nationkey % 2 = 0 GROUP BY 1) FULL JOIN (SELECT c_nationkey, count(*) AS nc FROM customer WHERE c_nationkey % 3 = 0 GROUP BY 1) ON s_nationkey = c_nationkey")
def full_outer(spark, sf):
    s = table(spark, sf, "supplier").where("s_nationkey % 2 = 0").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("suppliers"))
    c = table(spark, sf, "customer").where("c_nationkey % 3 = 0").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("customers"))
    return s.join(c, "nation", "full_outer").fillna(0)


@query("SELECT n_regionkey, list(n_name ORDER BY n_nationkey DESC) AS names, count(*) AS n FROM nation GROUP BY n_regionkey")
def map_by_value(spark, sf):
    """A map from name to number, its names by falling number."""
    one = F.map_from_entries(F.collect_list(F.struct("n_name", "n_nationkey")))
    m = table(spark, sf, "nation").groupBy("n_regionkey").agg(one.alias("m"))
    by_value = F.reverse(F.array_sort(F.transform(F.map_entries("m"), lambda e: F.struct(e["value"], e["key"]))))
    return m.select("n_regionkey", F.transform(by_value, lambda e: e["key"]).alias("names"), F.size("m").cast("long").alias("n"))
