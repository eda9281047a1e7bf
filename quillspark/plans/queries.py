"""Named queries over the test tables, each with its SQL where SQL can express it.

A document is an order or a text, a member a supplier or a part, an institution a
supplier, a state its nation, a country its region, a journal a market segment.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quillspark.functions import statistics as S, text as T, trend
from quillspark.operators import citations, counting, cube, graph, relational as R, resolve, terms, vectors, voting
from quillspark.session import checkpointed
from quillspark.tables import table

from .registry import ORACLES, QUERIES, query

# ---- building blocks shared by several queries ---------------------------------

PAIRS = """
    m AS (SELECT DISTINCT l_orderkey AS doc, l_suppkey AS member FROM lineitem),
    n AS (SELECT *, count(*) OVER (PARTITION BY doc) AS n FROM m),
    cells AS (SELECT x.member AS a, y.member AS b, x.n, count(*) AS c FROM n x JOIN n y ON x.doc = y.doc AND x.member < y.member GROUP BY ALL),
    pairs AS (SELECT a, b, sum(c / (n - 1)) AS weight, CAST(sum(c) AS BIGINT) AS documents FROM cells GROUP BY a, b)
"""


def supplier_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return graph.weighted_pairs(table(spark, sf, "lineitem"), "l_orderkey", "l_suppkey")


def nation_rows(spark: SparkSession, sf: str) -> DataFrame:
    """(doc, member): nations of each order's suppliers, a graph small enough for triangles."""
    return table(spark, sf, "lineitem").join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_orderkey").alias("doc"), F.col("s_nationkey").alias("member"))


# ---- graphs ---------------------------------------------------------------------


@query(f"WITH {PAIRS} SELECT a, b, round(weight, 6) AS weight, documents FROM pairs")
def weighted_pairs(spark, sf):
    return supplier_pairs(spark, sf).select("a", "b", F.round("weight", 6).alias("weight"), "documents")


@query("""
    WITH chosen AS (SELECT o_orderkey FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1998),
    m AS (SELECT DISTINCT l_orderkey AS doc, l_suppkey AS member FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM chosen)),
    n AS (SELECT *, count(*) OVER (PARTITION BY doc) AS n FROM m),
    cells AS (SELECT x.member AS a, y.member AS b, x.n, count(*) AS c FROM n x JOIN n y ON x.doc = y.doc AND x.member < y.member GROUP BY ALL)
    SELECT a, b, round(sum(c / (n - 1)), 6) AS weight, CAST(sum(c) AS BIGINT) AS documents FROM cells GROUP BY a, b
""")
def weighted_pairs_selected(spark, sf):
    chosen = table(spark, sf, "orders").where(F.year("o_orderdate").between(1996, 1998))
    rows = table(spark, sf, "lineitem").join(chosen, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    return graph.weighted_pairs(rows, "l_orderkey", "l_suppkey").select("a", "b", F.round("weight", 6).alias("weight"), "documents")


@query("""
    WITH m AS (SELECT DISTINCT l_orderkey AS doc, l_suppkey AS member FROM lineitem), n AS (SELECT *, count(*) OVER (PARTITION BY doc) AS n FROM m)
    SELECT member, count(*) AS strength FROM n WHERE n > 1 GROUP BY member
""")
def member_strength(spark, sf):
    return graph.strength(table(spark, sf, "lineitem"), "l_orderkey", "l_suppkey")


@query(f"WITH {PAIRS}, both_ways AS (SELECT a, weight FROM pairs UNION ALL SELECT b, weight FROM pairs) SELECT a AS node, count(*) AS degree, round(sum(weight), 4) AS weight FROM both_ways GROUP BY a")
def degree(spark, sf):
    return graph.degree(supplier_pairs(spark, sf)).withColumn("weight", F.round("weight", 4))


@query(f"WITH {PAIRS} SELECT a, b, CASE WHEN weight <= 0.5 + 1e-9 THEN 1 WHEN weight <= 1 + 1e-9 THEN 2 WHEN weight <= 3 + 1e-9 THEN 3 ELSE 4 END AS band FROM pairs")
def weight_bands(spark, sf):
    return graph.bands(supplier_pairs(spark, sf)).select("a", "b", "band")


@query(f"""
    WITH {PAIRS}, both_ways AS (SELECT a, b, weight, documents FROM pairs UNION ALL SELECT b, a, weight, documents FROM pairs)
    SELECT b AS node, round(weight, 6) AS weight, documents FROM both_ways WHERE a = 1
""")
def neighbours_of_node(spark, sf):
    return graph.neighbours(supplier_pairs(spark, sf), F.lit(1)).withColumn("weight", F.round("weight", 6))


NATION_EDGES = """
    m AS (SELECT DISTINCT l_orderkey AS doc, s_nationkey AS member FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
    n AS (SELECT *, count(*) OVER (PARTITION BY doc) AS n FROM m),
    cells AS (SELECT x.member AS a, y.member AS b, x.n, count(*) AS c FROM n x JOIN n y ON x.doc = y.doc AND x.member < y.member GROUP BY ALL),
    e AS (SELECT a, b, sum(c / (n - 1)) AS weight, CAST(sum(c) AS BIGINT) AS documents FROM cells GROUP BY a, b)
"""


def nation_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Every pair of nations."""
    return graph.weighted_pairs(nation_rows(spark, sf), "doc", "member")


@query(f"""
    WITH {NATION_EDGES}, ends AS (SELECT a AS node FROM e UNION ALL SELECT b FROM e),
    d AS (SELECT node, count(*) AS degree FROM ends GROUP BY node),
    t AS (SELECT x.a AS p, x.b AS q, y.b AS r FROM e x JOIN e y ON x.a = y.a AND x.b < y.b JOIN e z ON z.a = x.b AND z.b = y.b),
    tn AS (SELECT node, count(*) AS triangles FROM (SELECT p AS node FROM t UNION ALL SELECT q FROM t UNION ALL SELECT r FROM t) GROUP BY node)
    SELECT count(*) AS nodes, CAST(sum(degree) / 2 AS BIGINT) AS edges, round_even(2.0 * CAST(sum(degree) / 2 AS BIGINT) / (count(*) * (count(*) - 1)), 6) AS density,
           round_even(avg(degree), 3) AS mean_degree, round_even(avg(CASE WHEN degree > 1 THEN coalesce(triangles, 0) / (degree * (degree - 1) / 2) ELSE 0 END), 4) AS clustering
    FROM d LEFT JOIN tn USING (node)
""")
def graph_density_clustering(spark, sf):
    return graph.metrics(nation_edges(spark, sf))


@query(f"""
    WITH {NATION_EDGES}, g AS (SELECT n_nationkey AS node, n_regionkey AS community FROM nation),
    c AS (SELECT e.weight, x.community AS ca, y.community AS cb FROM e JOIN g x ON x.node = a JOIN g y ON y.node = b),
    ends AS (SELECT ca AS c, weight FROM c UNION ALL SELECT cb, weight FROM c),
    k AS (SELECT c, sum(weight) AS k FROM ends GROUP BY c),
    inside AS (SELECT ca AS c, sum(weight) AS inside FROM c WHERE ca = cb GROUP BY ca), whole AS (SELECT sum(weight) AS m FROM c)
    SELECT round(sum(coalesce(inside, 0) / m - (k / (2 * m)) * (k / (2 * m))), 6) AS modularity FROM k LEFT JOIN inside USING (c), whole
""")
def modularity_by_region(spark, sf):
    regions = table(spark, sf, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("community"))
    return graph.modularity(nation_edges(spark, sf), regions).select(F.round("modularity", 6).alias("modularity"))


STRONG = """
    spend AS (SELECT o_custkey AS c, year(o_orderdate) AS y, month(o_orderdate) AS mo, o_orderpriority AS p FROM orders),
    links AS (SELECT DISTINCT a, c AS b FROM (SELECT c, min(c) OVER (PARTITION BY y, mo, p) AS a FROM spend) WHERE a < c)
"""


def customer_links(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer of a (year, month, priority) with its least one: the components of all pairs, without the pairs."""
    spend = table(spark, sf, "orders").select(F.col("o_custkey").alias("b"), F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("mo"), F.col("o_orderpriority").alias("p"))
    least = spend.groupBy("y", "mo", "p").agg(F.min("b").alias("a"))
    return spend.join(least, ["y", "mo", "p"]).where("a < b").select("a", "b").distinct()


@query(f"""
    WITH RECURSIVE {STRONG}, both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
    reach AS (SELECT a AS node, a AS seen FROM both_ways UNION SELECT r.node, w.b FROM reach r JOIN both_ways w ON w.a = r.seen)
    SELECT node, min(seen) AS component FROM reach GROUP BY node
""")
def connected_components(spark, sf):
    return graph.component_labels(customer_links(spark, sf))


@query(f"""
    WITH RECURSIVE {STRONG}, both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
    reach AS (SELECT a AS node, a AS seen FROM both_ways UNION SELECT r.node, w.b FROM reach r JOIN both_ways w ON w.a = r.seen),
    labels AS (SELECT node, min(seen) AS component FROM reach GROUP BY node), sizes AS (SELECT component, count(*) AS n FROM labels GROUP BY component)
    SELECT count(*) AS components, max(n) AS largest, round(max(n) / sum(n), 6) AS share FROM sizes
""")
def component_summary(spark, sf):
    return graph.component_summary(graph.component_labels(customer_links(spark, sf))).withColumn("share", F.round("share", 6))


@query()
def louvain_communities(spark, sf):
    return graph.numbered_communities(graph.louvain(nation_edges(spark, sf)), least=3)


@query(f"""
    WITH {NATION_EDGES}, moved AS (SELECT least(x.n_regionkey, y.n_regionkey) AS a, greatest(x.n_regionkey, y.n_regionkey) AS b, weight, documents
        FROM e JOIN nation x ON x.n_nationkey = a JOIN nation y ON y.n_nationkey = b WHERE x.n_regionkey <> y.n_regionkey)
    SELECT a, b, round(sum(weight), 4) AS weight, CAST(sum(documents) AS BIGINT) AS documents FROM moved GROUP BY a, b
""")
def renumbered_edges(spark, sf):
    names = table(spark, sf, "nation").select(F.col("n_nationkey").alias("old"), F.col("n_regionkey").alias("new"))
    return graph.renumber(nation_edges(spark, sf), names).withColumn("weight", F.round("weight", 4))


# ---- counting --------------------------------------------------------------------

LINKS = """
    own AS (SELECT DISTINCT l_orderkey AS doc, l_linenumber - 1 AS author, s_suppkey AS institution, s_nationkey AS state, n_regionkey AS country
            FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE l_linenumber % 3 <> 0),
    docs AS (SELECT l_orderkey AS doc, CAST(max(l_linenumber) AS INTEGER) AS n_authors FROM lineitem GROUP BY 1),
    orphans AS (SELECT DISTINCT l_orderkey AS doc, s_suppkey AS institution, s_nationkey AS state, n_regionkey AS country
            FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE l_linenumber = 3 AND l_orderkey % 2 = 0),
    spine AS (SELECT doc, n_authors, unnest(range(n_authors)) AS author FROM docs),
    seen AS (SELECT s.*, EXISTS (SELECT 1 FROM own o WHERE o.doc = s.doc AND o.author = s.author) AS has FROM spine s),
    known AS (SELECT *, bool_or(NOT has) OVER (PARTITION BY doc) AS without FROM seen),
    taken AS (SELECT k.doc, k.author, n_authors, institution, state, country FROM known k JOIN own o ON o.doc = k.doc AND o.author = k.author
              UNION ALL SELECT k.doc, k.author, n_authors, institution, state, country FROM known k JOIN orphans o ON o.doc = k.doc WHERE NOT has OR NOT without),
    shares AS (SELECT *, 1.0 / n_authors / count(*) OVER (PARTITION BY doc, author) AS w FROM taken),
    weights AS (SELECT doc, institution, state, country, w FROM shares
                UNION ALL SELECT doc, NULL, NULL, NULL, 1.0 / n_authors FROM known k WHERE NOT EXISTS (SELECT 1 FROM taken t WHERE t.doc = k.doc AND t.author = k.author))
"""


def fractional_weights(spark: SparkSession, sf: str) -> DataFrame:
    places = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    lines = table(spark, sf, "lineitem").join(places, F.col("l_suppkey") == F.col("s_suppkey"))
    named = lambda author: [F.col("l_orderkey").alias("doc"), author.alias("author"), F.col("s_suppkey").alias("institution"), F.col("s_nationkey").alias("state"), F.col("n_regionkey").alias("country")]
    own = lines.where("l_linenumber % 3 <> 0").select(*named(F.col("l_linenumber") - 1))
    orphans = lines.where("l_linenumber = 3 AND l_orderkey % 2 = 0").select(*named(F.lit(None).cast("int")))
    docs = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("doc")).agg(F.max("l_linenumber").cast("int").alias("n_authors"))
    return counting.fractional(docs, own.unionByName(orphans).distinct(), ["institution", "state", "country"])


@query(f"WITH {LINKS} SELECT state, round(sum(w), 4) AS weight, count(DISTINCT doc) AS documents FROM weights WHERE state IS NOT NULL GROUP BY state")
def fractional_count_nation(spark, sf):
    return counting.by_place(fractional_weights(spark, sf), "state").withColumn("weight", F.round("weight", 4))


@query(f"WITH {LINKS} SELECT country, round(sum(w), 4) AS weight, count(DISTINCT doc) AS documents FROM weights WHERE country IS NOT NULL GROUP BY country")
def fractional_count_region(spark, sf):
    return counting.by_place(fractional_weights(spark, sf), "country").withColumn("weight", F.round("weight", 4))


@query(f"""
    WITH {LINKS} SELECT round(sum(CASE WHEN institution IS NOT NULL THEN w ELSE 0 END) / sum(w), 6) AS identified, round(sum(CASE WHEN country = 1 THEN w ELSE 0 END) / sum(w), 6) AS home, round(sum(w), 3) AS total FROM weights
""")
def weight_coverage(spark, sf):
    w = fractional_weights(spark, sf)
    shares = counting.coverage(w, {"identified": "institution IS NOT NULL", "home": "country = 1"})
    return shares.crossJoin(w.agg(F.round(F.sum("weight"), 3).alias("total"))).select(F.round("identified", 6).alias("identified"), F.round("home", 6).alias("home"), "total")


@query(f"WITH {LINKS} SELECT institution, round(sum(w), 4) AS weight, count(DISTINCT doc) AS documents, min(state) AS state FROM weights WHERE institution IS NOT NULL GROUP BY institution")
def institution_summary(spark, sf):
    return counting.institution_summary(fractional_weights(spark, sf)).withColumn("weight", F.round("weight", 4))


@query("""
    WITH l AS (SELECT o_orderkey AS doc, year(o_orderdate) AS y, l_suppkey, s_nationkey, n_regionkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
    d AS (SELECT doc, y, count(DISTINCT l_suppkey) AS a, count(DISTINCT s_nationkey) AS s, max(CAST(n_regionkey = 1 AS INT)) AS home, max(CAST(n_regionkey <> 1 AS INT)) AS abroad FROM l GROUP BY doc, y)
    SELECT CAST(y AS INTEGER) AS year, round(avg(CAST(a > 1 AS INT)), 6) AS several_authors, round(avg(a), 6) AS mean_authors, round(avg(CAST(s > 1 AS INT)), 6) AS several_states,
           round(avg(CAST(home = 1 AND abroad = 1 AS INT)), 6) AS home_and_abroad FROM d GROUP BY y
""")
def collaboration_by_year(spark, sf):
    lines = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    rows = lines.join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    members = rows.select(F.col("o_orderkey").alias("doc"), F.year("o_orderdate").alias("year"), F.col("l_suppkey").alias("author"), F.col("l_suppkey").alias("institution"), F.col("s_nationkey").alias("state"), (F.col("n_regionkey") == 1).alias("home"))
    out = counting.collaboration(members, "year")
    return out.select("year", *(F.round(c, 6).alias(c) for c in ("several_authors", "mean_authors", "several_states", "home_and_abroad")))


@query("""
    WITH v AS (SELECT c_custkey, o_orderpriority, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY ALL),
    t AS (SELECT *, sum(n) OVER (PARTITION BY c_custkey) AS total, row_number() OVER (PARTITION BY c_custkey ORDER BY n DESC, o_orderpriority) AS r FROM v)
    SELECT c_custkey, o_orderpriority FROM t WHERE r = 1 AND n >= 2 AND n >= 0.4 * total
""")
def consensus_value(spark, sf):
    rows = table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    return R.consensus(rows, ["c_custkey"], "o_orderpriority", votes=2, share=0.4)


@query("""
    WITH v AS (SELECT c_mktsegment, o_orderpriority, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY ALL)
    SELECT c_mktsegment, o_orderpriority, n FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY n DESC, o_orderpriority) AS r FROM v) WHERE r = 1
""")
def modal_value_tiebreak(spark, sf):
    rows = table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    return R.most_common(rows, ["c_mktsegment"], "o_orderpriority")


# ---- series, cube, filters ---------------------------------------------------------


@query("""
    SELECT p_type AS topic, CAST(year(o_orderdate) AS INTEGER) AS year, c_mktsegment AS journal, count(DISTINCT o_orderkey) AS n
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL
""")
def topic_year_journal(spark, sf):
    rows = (
        table(spark, sf, "lineitem")
        .join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    )
    return rows.groupBy(F.col("p_type").alias("topic"), F.year("o_orderdate").alias("year"), F.col("c_mktsegment").alias("journal")).agg(F.countDistinct("o_orderkey").alias("n"))


TYPE_YEARS = """
    totals AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS total FROM orders GROUP BY 1),
    hits AS (SELECT p_type AS topic, CAST(year(o_orderdate) AS INTEGER) AS year, count(DISTINCT o_orderkey) AS n FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)
"""


def type_years(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"))
    totals = orders.groupBy("year").agg(F.count(F.lit(1)).alias("total"))
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.groupBy(F.col("p_type").alias("topic"), "year").agg(F.countDistinct("o_orderkey").alias("n")), totals


@query(f"""
    WITH {TYPE_YEARS}, years AS (SELECT CAST(unnest(range(min(year), max(year) + 1)) AS INTEGER) AS year FROM totals), spine AS (SELECT * FROM (SELECT DISTINCT topic FROM hits), years)
    SELECT topic, year, coalesce(n, 0) AS n, round_even(coalesce(coalesce(n, 0) / total, 0), 5) AS share FROM spine LEFT JOIN hits USING (topic, year) LEFT JOIN totals USING (year)
""")
def dense_series_share(spark, sf):
    hits, totals = type_years(spark, sf)
    return R.dense_series(hits, "topic", "year", "n", totals)


@query()
def trend_by_type(spark, sf):
    hits, totals = type_years(spark, sf)
    series = R.dense_series(hits, "topic", "year", "n", totals).join(totals, "year")
    return trend.trends(series, "topic")


CUBE = {"year": "year", "journal": "c_mktsegment", "topic": "o_orderpriority", "country": "n_regionkey"}


def cube_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).withColumn("year", F.year("o_orderdate"))
    tests = {"year": F.col("year").between(1996, 1999), "journal": F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "topic": F.col("o_orderpriority") != "5-LOW", "country": F.col("n_regionkey").isin(0, 2)}
    return cube.failures(rows, tests)


CUBE_SQL = """
    r AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, c_mktsegment, o_orderpriority, n_regionkey,
                 year(o_orderdate) BETWEEN 1996 AND 1999 AS a, c_mktsegment IN ('BUILDING', 'MACHINERY') AS b, o_orderpriority <> '5-LOW' AS c, n_regionkey IN (0, 2) AS d
          FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
"""


@query(f"""
    WITH {CUBE_SQL} SELECT 'year' AS dimension, CAST(year AS VARCHAR) AS value, count(*) AS n FROM r WHERE b AND c AND d GROUP BY 2
    UNION ALL SELECT 'journal', c_mktsegment, count(*) FROM r WHERE a AND c AND d GROUP BY 2
    UNION ALL SELECT 'topic', o_orderpriority, count(*) FROM r WHERE a AND b AND d GROUP BY 2
    UNION ALL SELECT 'country', CAST(n_regionkey AS VARCHAR), count(*) FROM r WHERE a AND b AND c GROUP BY 2
""")
def cross_filter_excluding_self(spark, sf):
    return cube.counts_without_own(cube_rows(spark, sf), CUBE)


@query(f"WITH {CUBE_SQL} SELECT c_mktsegment, o_orderpriority, count(*) AS n FROM r WHERE a AND b AND c AND d GROUP BY ALL")
def cross_filter_cells(spark, sf):
    return cube.passing(cube_rows(spark, sf)).groupBy("c_mktsegment", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


POLYGON = [(20_000.0, 10.0), (150_000.0, 40.0), (300_000.0, 20.0), (250_000.0, 200.0), (120_000.0, 120.0), (60_000.0, 300.0)]


def _crossings(x: str, y: str) -> str:
    edges = zip(POLYGON, POLYGON[1:] + POLYGON[:1], strict=True)
    return " + ".join(f"CASE WHEN (({y} < {y1}) <> ({y} < {y2})) AND {x} < CAST({x2 - x1} AS DOUBLE) * ({y} - {y1}) / CAST({y2 - y1} AS DOUBLE) + {x1} THEN 1 ELSE 0 END" for (x1, y1), (x2, y2) in edges)


@query(f"SELECT o_orderkey FROM (SELECT o_orderkey, o_totalprice AS x, CAST(dayofyear(o_orderdate) AS DOUBLE) AS y FROM orders) WHERE ({_crossings('x', 'y')}) % 2 = 1")
def point_in_polygon(spark, sf):
    return table(spark, sf, "orders").where(cube.inside(POLYGON, F.col("o_totalprice"), F.dayofyear("o_orderdate").cast("double"))).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_orderkey = o_orderkey AND s_nationkey = 3)")
def semi_place_filter(spark, sf):
    places = table(spark, sf, "lineitem").join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).withColumnRenamed("l_orderkey", "o_orderkey")
    return cube.at_any_place(table(spark, sf, "orders"), places, "o_orderkey", F.col("s_nationkey") == 3).select("o_orderkey")


@query(f"WITH {PAIRS}, s AS (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000) SELECT a, b, documents FROM pairs WHERE a IN (SELECT s_suppkey FROM s) AND b IN (SELECT s_suppkey FROM s)")
def both_ends_filter(spark, sf):
    return cube.both_ends(supplier_pairs(spark, sf), table(spark, sf, "supplier").where("s_acctbal > 5000"), "s_suppkey").select("a", "b", "documents")


@query("""
    WITH w AS (SELECT doc_id, unnest(list_distinct(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'))) AS t FROM documents),
    hits AS (SELECT doc_id, max(CAST(t LIKE 'that%' AS INT)) AS a, max(CAST(t LIKE 'with%' AS INT)) AS b FROM w GROUP BY doc_id)
    SELECT doc_id, CAST(2.0 AS DOUBLE) AS score FROM hits WHERE a = 1 AND b = 1
""")
def text_search(spark, sf):
    """Prefix search with both words; words of four letters have no fuzzy matches."""
    return cube.search(table(spark, sf, "documents"), "that with", "doc_id", {"text": 1.0})


# ---- projections, unnesting, ranked picks -------------------------------------------


@query("SELECT doc_id, CAST(i AS INTEGER) AS ordinal, words[i] AS value FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM (SELECT doc_id, string_split(text, ' ') AS words FROM documents))")
def unnest_ordinality(spark, sf):
    return R.with_ordinality(table(spark, sf, "documents").select("doc_id", F.split("text", " ").alias("words")), "doc_id", "words")


@query("""
    SELECT CAST(conv_id AS BIGINT) AS conv_id, kind, text FROM (
        SELECT conv_id, 'user' AS kind, text FROM conversations WHERE role = 'user' UNION ALL SELECT conv_id, 'assistant', text FROM conversations WHERE role = 'assistant')
""")
def unnest_union_tag(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_list(F.when(F.col("role") == "user", F.struct("text"))).alias("u"), F.collect_list(F.when(F.col("role") == "assistant", F.struct("text"))).alias("a"))
    return R.unnest(c, "conv_id", {"u": "user", "a": "assistant"})


@query("""
    SELECT 'documents' AS metric, '' AS key, count(*) AS value FROM documents UNION ALL SELECT 'languages', '', count(DISTINCT lang) FROM documents
    UNION ALL SELECT 'long', '', count(*) FILTER (WHERE n_chars > 2000) FROM documents UNION ALL SELECT 'language', lang, count(*) FROM documents GROUP BY lang
    UNION ALL SELECT 'source', coalesce(source, '?'), count(*) FROM documents GROUP BY ALL
""")
def coverage_summary(spark, sf):
    d = table(spark, sf, "documents")
    one = d.agg(F.count(F.lit(1)).alias("documents"), F.countDistinct("lang").alias("languages"), F.count_if(F.col("n_chars") > 2000).alias("long"))
    head = one.unpivot([], ["documents", "languages", "long"], "metric", "value").select("metric", F.lit("").alias("key"), "value")
    by = lambda m, c: d.groupBy(F.coalesce(c, F.lit("?")).alias("key")).agg(F.count(F.lit(1)).alias("value")).select(F.lit(m).alias("metric"), "key", "value")
    return head.unionByName(by("language", F.col("lang"))).unionByName(by("source", F.col("source")))


@query("""
    WITH n AS (SELECT l_partkey, count(DISTINCT l_orderkey) AS citers FROM lineitem GROUP BY 1)
    SELECT l_partkey AS part, citers, CAST(row_number() OVER (ORDER BY citers DESC, l_partkey) AS INTEGER) AS rank FROM n ORDER BY citers DESC, l_partkey LIMIT 200
""")
def cited_topk(spark, sf):
    """A top-k report: the 200 parts of most orders."""
    n = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("part")).agg(F.countDistinct("l_orderkey").alias("citers"))
    return n.orderBy(F.desc("citers"), "part").limit(200).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("citers"), "part")))


@query("SELECT * FROM (SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM orders) WHERE rank <= 3")
def top_per_group(spark, sf):
    return R.top_per_group(table(spark, sf, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", "rank")


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_by_key(spark, sf):
    return R.latest(table(spark, sf, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id", "value")


@query("""
    WITH n AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) - 1 AS i, count(*) OVER () AS n FROM orders)
    SELECT min(v) FILTER (WHERE i = CAST(round_even(0.005 * (n - 1), 0) AS BIGINT)) AS q0, min(v) FILTER (WHERE i = CAST(round_even(0.995 * (n - 1), 0) AS BIGINT)) AS q1 FROM n
""")
def nearest_rank_quantiles(spark, sf):
    return R.nearest_rank(table(spark, sf, "orders"), "o_totalprice", [0.005, 0.995])


@query("SELECT c_mktsegment AS segment, median(o_totalprice) AS median FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def median_by_group(spark, sf):
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.median("o_totalprice").alias("median"))


@query("""
    WITH a AS (SELECT doc_id AS k, lang AS v FROM documents WHERE doc_id % 5 <> 0), b AS (SELECT doc_id AS k, CASE WHEN doc_id % 7 = 0 THEN 'xx' ELSE lang END AS v FROM documents WHERE doc_id % 6 <> 0)
    SELECT k AS doc_id, CASE WHEN a.k IS NULL THEN 'entered' WHEN b.k IS NULL THEN 'left' ELSE 'changed' END AS change FROM a FULL JOIN b USING (k) WHERE a.k IS NULL OR b.k IS NULL OR a.v IS DISTINCT FROM b.v
""")
def run_comparison(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang")
    after = d.where("doc_id % 6 <> 0").withColumn("lang", F.when(F.col("doc_id") % 7 == 0, "xx").otherwise(F.col("lang")))
    return R.compare_runs(d.where("doc_id % 5 <> 0"), after, "doc_id", "lang")


@query("""
    WITH r AS (SELECT l_partkey, row_number() OVER (ORDER BY n DESC, l_partkey) AS rank FROM (SELECT l_partkey, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1)),
    b AS (SELECT l_orderkey, min(rank) AS best FROM lineitem JOIN r USING (l_partkey) GROUP BY 1)
    SELECT CAST(k AS INTEGER) AS k, count(*) FILTER (WHERE k = -1 OR best <= k) AS documents, round(count(*) FILTER (WHERE k = -1 OR best <= k) / count(*), 6) AS share FROM b, (SELECT unnest([1, 10, 50, -1]) AS k) GROUP BY k
""")
def cumulative_reach(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_partkey").alias("work"))
    most = lines.groupBy("work").agg(F.countDistinct("doc").alias("n")).orderBy(F.desc("n"), "work").limit(50)
    ranks = most.select("work", F.row_number().over(Window.orderBy(F.desc("n"), "work")).alias("rank"))
    return R.cumulative_reach(lines, ranks, "doc", "work", [1, 10, 50, R.ALL_WORKS]).withColumn("share", F.round("share", 6))


@query("""
    WITH s AS (SELECT c_mktsegment AS stratum, count(*) AS size FROM customer GROUP BY 1), t AS (SELECT sum(size) AS total, least(200, sum(size)) AS places FROM s),
    q AS (SELECT stratum, size, places, size * places / CAST(total AS DOUBLE) AS quota FROM s, t),
    b AS (SELECT *, least(size, greatest(CAST(floor(quota) AS BIGINT), 1)) AS base, row_number() OVER (ORDER BY quota - floor(quota) DESC, stratum) AS r FROM q)
    SELECT stratum, size, base + CASE WHEN r <= places - (SELECT sum(base) FROM b) THEN 1 ELSE 0 END AS allocated FROM b
""")
def stratified_allocation(spark, sf):
    """Largest remainders of 200 places, or of all rows if there are fewer."""
    sizes = table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("stratum")).agg(F.count(F.lit(1)).alias("size"))
    return R.largest_remainder(sizes, 200)


@query("""
    WITH h AS (SELECT c_mktsegment, c_custkey, sha256('7|' || CAST(c_custkey AS VARCHAR)) AS h FROM customer)
    SELECT c_mktsegment, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY h, c_custkey) AS r FROM h) WHERE r <= 20
""")
def stratified_hash_sample(spark, sf):
    """A sampling operator: twenty customers of each segment by hash."""
    c = table(spark, sf, "customer")
    strata = c.select(F.col("c_mktsegment").alias("stratum")).distinct().withColumn("allocated", F.lit(20))
    return R.hash_sample(c, strata, "c_mktsegment", "c_custkey").select("c_mktsegment", "c_custkey")


@query("SELECT doc_id FROM documents ORDER BY sha256('7|' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 50")
def audit_sample(spark, sf):
    """A sampling operator: the fifty lowest hashes."""
    return voting.audit_sample(table(spark, sf, "documents"), ["doc_id"], 50).select("doc_id")


# ---- agreement and statistics ---------------------------------------------------------

VOTES = """
    votes AS (SELECT d.doc_id, l.quality AS a, CASE WHEN n_chars >= 1000 THEN 1 ELSE 0 END AS b, CASE WHEN lang = 'en' THEN 1 ELSE 0 END AS c FROM documents d JOIN labels l USING (doc_id))
"""


def rated(spark: SparkSession, sf: str) -> DataFrame:
    j = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return j.select("doc_id", F.col("quality").alias("a"), (F.col("n_chars") >= 1000).cast("int").alias("b"), (F.col("lang") == "en").cast("int").alias("c"))


@query(f"""
    WITH {VOTES}, n AS (SELECT count(*) AS n, sum(CAST(a = b AS INT)) AS same FROM votes),
    x AS (SELECT a AS v, count(*) AS k FROM votes GROUP BY a), y AS (SELECT b AS v, count(*) AS k FROM votes GROUP BY b),
    ch AS (SELECT sum(coalesce(x.k, 0) * coalesce(y.k, 0)) AS chance, count(*) AS seen FROM x FULL JOIN y USING (v))
    SELECT n, round(same / n, 6) AS observed, round((same / n - chance / (n * n)) / (1 - chance / (n * n)), 6) AS kappa, round((seen * (same / n) - 1) / (seen - 1), 6) AS pabak FROM n, ch
""")
def kappa_pabak(spark, sf):
    return S.agreement(rated(spark, sf), "a", "b").select("n", *(F.round(c, 6).alias(c) for c in ("observed", "kappa", "pabak")))


@query(f"WITH {VOTES} SELECT a, b, count(*) AS n FROM votes GROUP BY a, b")
def confusion(spark, sf):
    return S.confusion(rated(spark, sf), "a", "b")


@query(f"""
    WITH {VOTES}, k AS (SELECT unnest([0, 1]) AS class)
    SELECT CAST(class AS INTEGER) AS class, round(sum(CAST(a = class AND b = class AS INT)) / sum(CAST(b = class AS INT)), 6) AS precision, round(sum(CAST(a = class AND b = class AS INT)) / sum(CAST(a = class AS INT)), 6) AS recall,
           round(2 * sum(CAST(a = class AND b = class AS INT)) / (sum(CAST(a = class AS INT)) + sum(CAST(b = class AS INT))), 6) AS f1, CAST(sum(CAST(a = class AS INT)) AS BIGINT) AS n FROM votes, k GROUP BY class
""")
def class_prf(spark, sf):
    return S.per_class(rated(spark, sf), "a", "b").select("class", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")), "n")


@query(f"""
    WITH {VOTES}, long AS (SELECT doc_id, a AS v FROM votes UNION ALL SELECT doc_id, b FROM votes WHERE doc_id % 4 <> 0 UNION ALL SELECT doc_id, c FROM votes WHERE doc_id % 3 <> 0),
    cells AS (SELECT doc_id, v, count(*) AS c FROM long GROUP BY ALL), units AS (SELECT doc_id, sum(c) AS m, sum(c * c) AS s FROM cells GROUP BY doc_id HAVING sum(c) > 1),
    marg AS (SELECT v, sum(c) AS n FROM cells JOIN units USING (doc_id) GROUP BY v), o AS (SELECT sum((m * m - s) / (m - 1)) AS o FROM units), e AS (SELECT sum(n) AS n, sum(n * n) AS s FROM marg)
    SELECT round(1 - (n - 1) * o / (n * n - s), 6) AS alpha FROM o, e
""")
def krippendorff_alpha(spark, sf):
    v = rated(spark, sf)
    long = v.select("doc_id", F.col("a").alias("v")).unionByName(v.where("doc_id % 4 <> 0").select("doc_id", F.col("b").alias("v"))).unionByName(v.where("doc_id % 3 <> 0").select("doc_id", F.col("c").alias("v")))
    return S.krippendorff_alpha(long, "doc_id", "v").withColumn("alpha", F.round("alpha", 6))


@query()
def kappa_interval(spark, sf):
    return S.kappa_interval(rated(spark, sf), "a", "b", "doc_id")


@query(f"WITH {VOTES} SELECT count(*) FILTER (WHERE b = a AND c <> a) AS only_first, count(*) FILTER (WHERE b <> a AND c = a) AS only_second FROM votes")
def mcnemar_counts(spark, sf):
    return S.mcnemar(rated(spark, sf), "a", "b", "c").withColumn("p", F.round("p", 8)).drop("p")


@query(f"""
    WITH {VOTES}, n AS (SELECT count(*) FILTER (WHERE b = a AND c <> a) AS x, count(*) FILTER (WHERE b <> a AND c = a) AS y FROM votes),
    s AS (SELECT x, y, list_sum(list_transform(range(0, least(x, y) + 1), lambda i: exp(lgamma(x + y + 1) - lgamma(i + 1) - lgamma(x + y - i + 1) - (x + y) * ln(2)))) AS half FROM n)
    SELECT x AS only_first, y AS only_second, round(least(1.0, 2 * half), 8) AS p FROM s
""")
def mcnemar_exact(spark, sf):
    return S.mcnemar(rated(spark, sf), "a", "b", "c").withColumn("p", F.round("p", 8))


@query("""
    WITH s AS (SELECT source, count(*) AS n, sum(toxic) AS k FROM documents JOIN labels USING (doc_id) GROUP BY source), z AS (SELECT 1.959963984540054 AS z), p AS (SELECT *, k / n AS p FROM s, z)
    SELECT source, n, CAST(k AS BIGINT) AS k, round(greatest(0, (p + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)), 6) AS low,
           round(least(1, (p + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)), 6) AS high FROM p
""")
def wilson_interval(spark, sf):
    s = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("k"))
    w = S.wilson(F.col("k"), F.col("n"))
    return s.select("source", "n", "k", F.round(w["low"], 6).alias("low"), F.round(w["high"], 6).alias("high"))


@query("""
    WITH c AS (SELECT label AS a, CAST(vec_id % 10 AS INTEGER) AS b, count(*) AS n FROM embeddings GROUP BY ALL), x AS (SELECT sum(n * (n - 1) / 2) AS cells, sum(n) AS t FROM c),
    r AS (SELECT sum(n * (n - 1) / 2) AS r FROM (SELECT sum(n) AS n FROM c GROUP BY a)), k AS (SELECT sum(n * (n - 1) / 2) AS k FROM (SELECT sum(n) AS n FROM c GROUP BY b))
    SELECT round((cells - r * k / (t * (t - 1) / 2)) / ((r + k) / 2 - r * k / (t * (t - 1) / 2)), 6) AS ari FROM x, r, k
""")
def ari(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("label").alias("a"), (F.col("vec_id") % 10).cast("int").alias("b"))
    return S.adjusted_rand(e, "a", "b").withColumn("ari", F.round("ari", 6))


@query("""
    WITH c AS (SELECT label AS a, CAST(vec_id % 10 AS INTEGER) AS b, count(*) AS j FROM embeddings GROUP BY ALL), a AS (SELECT label AS a, count(*) AS na FROM embeddings GROUP BY 1), b AS (SELECT CAST(vec_id % 10 AS INTEGER) AS b, count(*) AS nb FROM embeddings GROUP BY 1)
    SELECT a, b, round(j / (na + nb - j), 6) AS jaccard FROM c JOIN a USING (a) JOIN b USING (b)
""")
def jaccard_of_labelings(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("label").alias("a"), (F.col("vec_id") % 10).cast("int").alias("b"))
    return R.jaccard(e, "a", "b").withColumn("jaccard", F.round("jaccard", 6))


@query()
def topic_assignment(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("label").alias("a"), F.when(F.col("vec_id") % 3 == 0, F.col("vec_id") % 10).otherwise(F.col("label")).cast("int").alias("b"))
    return R.assignment(R.jaccard(e, "a", "b"), "a", "b", "jaccard", 0.3)


# ---- voting -----------------------------------------------------------------------------


def ballots(spark: SparkSession, sf: str) -> DataFrame:
    v = rated(spark, sf)
    status = lambda d, m: F.when(F.col("doc_id") % d == m, "absent").otherwise("literal")
    parts = [v.select("doc_id", F.lit(c).alias("member"), F.col(c).cast("string").alias("value"), status(5, i).alias("status")) for i, c in enumerate("abc")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


BALLOTS = f"""
    {VOTES}, ballots AS (SELECT doc_id, CAST(a AS VARCHAR) AS value, CASE WHEN doc_id % 5 = 0 THEN 'absent' ELSE 'literal' END AS status FROM votes
        UNION ALL SELECT doc_id, CAST(b AS VARCHAR), CASE WHEN doc_id % 5 = 1 THEN 'absent' ELSE 'literal' END FROM votes
        UNION ALL SELECT doc_id, CAST(c AS VARCHAR), CASE WHEN doc_id % 5 = 2 THEN 'absent' ELSE 'literal' END FROM votes)
"""


@query(f"""
    WITH {BALLOTS}, k AS (SELECT doc_id, value, count(*) AS k, max(CAST(status <> 'absent' AS INT)) AS evident FROM ballots GROUP BY ALL),
    t AS (SELECT *, sum(k) OVER (PARTITION BY doc_id) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY k DESC, value) AS r FROM k),
    s AS (SELECT doc_id, value, CASE WHEN k = n THEN 'unanimous' WHEN 2 * k > n AND evident = 1 THEN 'majority' ELSE 'undecided' END AS stage FROM t WHERE r = 1)
    SELECT doc_id, CASE WHEN stage <> 'undecided' THEN value END AS value, stage FROM s
""")
def jury_vote(spark, sf):
    return voting.decide_single(ballots(spark, sf), ["doc_id"])


@query(f"""
    WITH {BALLOTS}, sets AS (SELECT doc_id, CASE WHEN value = '1' THEN ['x'] || CASE WHEN doc_id % 2 = 0 THEN ['y'] ELSE [] END ELSE ['z'] END AS v, status FROM ballots),
    n AS (SELECT doc_id, count(*) AS n, count(DISTINCT v) AS kinds, min(v) AS sole FROM sets GROUP BY doc_id),
    each AS (SELECT doc_id, c, count(*) AS k FROM (SELECT doc_id, unnest(v) AS c FROM sets) GROUP BY ALL),
    chosen AS (SELECT doc_id, list(c ORDER BY c) AS v FROM each JOIN n USING (doc_id) WHERE 2 * k > n GROUP BY doc_id),
    same AS (SELECT doc_id, v, max(CAST(status <> 'absent' AS INT)) AS evident FROM sets JOIN chosen USING (doc_id, v) GROUP BY ALL),
    s AS (SELECT n.doc_id, sole, same.v, CASE WHEN kinds = 1 THEN 'unanimous' WHEN coalesce(evident, 0) = 1 THEN 'majority' ELSE 'undecided' END AS stage FROM n LEFT JOIN same USING (doc_id))
    SELECT doc_id, '["' || array_to_string(CASE stage WHEN 'unanimous' THEN sole WHEN 'majority' THEN v END, '","') || '"]' AS value, stage FROM s
""")
def jury_vote_multiple(spark, sf):
    x = F.when(F.col("value") == "1", F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("x"), F.lit("y"))).otherwise(F.array(F.lit("x")))).otherwise(F.array(F.lit("z")))
    return voting.decide_multiple(ballots(spark, sf).withColumn("value", x), ["doc_id"])


@query(f"SELECT doc_id, CAST(c AS INTEGER) AS n FROM (WITH {BALLOTS} SELECT doc_id, count(*) AS c FROM ballots WHERE status <> 'absent' GROUP BY doc_id) WHERE c = 3")
def complete_items(spark, sf):
    """Items for which all three members gave evidence."""
    b = ballots(spark, sf).where("status <> 'absent'")
    return voting.complete_items(b, ["doc_id"], "member", 3).groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("n"))


@query("""
    WITH j AS (SELECT source, count(*) AS n, sum(CAST(quality <> CAST(n_chars >= 1000 AS INT) AS INT)) AS errors FROM documents JOIN labels USING (doc_id) GROUP BY source)
    SELECT source, n, CAST(errors AS BIGINT) AS errors, round(errors / n, 6) AS rate FROM j
""")
def audit_rates(spark, sf):
    j = rated(spark, sf).join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id").withColumn("wrong", F.col("a") != F.col("b"))
    return voting.audit_rates(j, "source", "wrong").select("source", "n", "errors", F.round("rate", 6).alias("rate"))


@query("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def pending_items(spark, sf):
    return voting.pending(table(spark, sf, "documents"), table(spark, sf, "labels"), ["doc_id"]).select("doc_id")


# ---- text ---------------------------------------------------------------------------------


def _hits(lang: str) -> str:
    words = ", ".join(f"'{w}'" for w in T.FUNCTION_WORDS[lang].split())
    return f"len(list_filter(w, lambda x: x IN ({words})))"


@query(f"""
    WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}]+') AS w FROM documents),
    h AS (SELECT doc_id, len(w) AS words, unnest([{', '.join(f"{{'hits': {_hits(x)}, 'language': '{x}'}}" for x in sorted(T.FUNCTION_WORDS))}]) AS h FROM w),
    r AS (SELECT doc_id, words, h.hits AS hits, h.language AS language, row_number() OVER (PARTITION BY doc_id ORDER BY h.hits DESC, h.language DESC) AS r FROM h),
    t AS (SELECT doc_id, words, max(language) FILTER (WHERE r = 1) AS language, max(hits) FILTER (WHERE r = 1) AS hits, max(hits) FILTER (WHERE r = 2) AS second FROM r GROUP BY ALL)
    SELECT doc_id, language, CAST(hits AS BIGINT) AS hits, CAST(words AS BIGINT) AS words, CASE WHEN words >= 15 AND hits >= 5 AND hits >= 2.0 * second THEN language END AS detected FROM t
""")
def language_hits(spark, sf):
    return T.language_hits(table(spark, sf, "documents"), "doc_id", "text")


@query("""
    SELECT doc_id, len(regexp_extract_all(trim(text), '[\\p{L}]+')) < 15 OR NOT regexp_matches(ltrim(trim(text), '"''“‘«¿¡(['), '^\\p{Lu}|^((1[5-9]|20)\\d\\d([^\\d.\\])]|$)|\\d+([.,]\\d+)?\\s?%|\\d+([ºª]|st|nd|rd|th)|\\d+\\s+[a-zà-ÿ])') AS fragment
    FROM documents
""")
def fragment_flag(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.is_fragment(F.col("text"), F.lit(True)).alias("fragment"))


@query("""
    WITH f AS (SELECT doc_id, source, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS f FROM documents),
    n AS (SELECT f, count(DISTINCT doc_id) AS n, count(DISTINCT CASE WHEN source = 'src0' THEN doc_id END) AS k FROM f GROUP BY f)
    SELECT doc_id FROM f JOIN n USING (f) WHERE NOT (n >= 2 AND CASE WHEN source = 'src0' THEN k >= 3 ELSE true END)
""")
def boilerplate_docs(spark, sf):
    return resolve.boilerplate(table(spark, sf, "documents"), "doc_id", "text", "source", "src0").select("doc_id")


@query("""
    WITH f AS (SELECT doc_id, lower(regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g')) AS f FROM documents) SELECT doc_id, min(doc_id) OVER (PARTITION BY f) AS kept FROM f
""")
def exact_duplicates(spark, sf):
    # the texts are read and hashed once; what meets are ids and hashes
    own = checkpointed(table(spark, sf, "documents").select("doc_id", F.sha2(F.lower(F.regexp_replace("text", "[^A-Za-z0-9]+", " ")), 256).alias("f")))
    return own.join(own.groupBy("f").agg(F.min("doc_id").alias("kept")), "f").select("doc_id", "kept")


@query("SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM pages")
def clean_html_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.clean_markup(F.col("html")).alias("text"))


@query()
def clean_text_arrow(spark, sf):
    """Entities and composed characters as well: needs Arrow."""
    return table(spark, sf, "pages").select("page_id", T.clean_text("html").alias("text"))


@query("SELECT doc_id, regexp_extract_all(text, '[\\w.+-]+@[\\w-]+(?:\\.[\\w-]+)+') <> [] AS has_email FROM documents")
def email_flag(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.has_email("text").alias("has_email"))


@query()
def emails_removed(spark, sf):
    """Every document, as addresses are also spelled out or have other signs."""
    return table(spark, sf, "documents").select("doc_id", T.remove_emails("text").alias("text"))


@query("""
    WITH h AS (SELECT 'doc-' || CAST(doc_id AS VARCHAR) AS id FROM documents),
    f AS (SELECT id, list_reduce([CAST(2166136261 AS BIGINT)] || list_transform(range(1, length(id) + 1), lambda i: CAST(ascii(id[i]) AS BIGINT)), lambda s, b: (xor(s, b) * 16777619) & 4294967295) AS h FROM h)
    SELECT printf('%02x', h % 64) AS fragment, count(*) AS n FROM f GROUP BY 1
""")
def hash_fragment(spark, sf):
    ids = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))
    return table(spark, sf, "documents").groupBy(T.fragment(ids).alias("fragment")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, item_id, CAST(strpos(lower(d.text), lower(b.text)) AS INTEGER) AS position FROM documents d JOIN benchmark b ON contains(lower(d.text), lower(b.text))")
def evidence_literal(spark, sf):
    return literal_passages(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


#: Passages that are looked for at once; their automaton goes to every task.
MOST_PASSAGES = 1_000_000


def passage_list(passages: DataFrame) -> list[tuple]:
    """(item_id, text) of a bounded list of passages."""
    rows = passages.select("item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL").limit(MOST_PASSAGES + 1).collect()
    if len(rows) > MOST_PASSAGES:
        raise ValueError(f"more than {MOST_PASSAGES} passages; look for them in parts")
    return [tuple(r) for r in rows]


def literal_passages(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """(doc_id, item_id, position) of passages, in lower case, in whole texts; passages are a bounded list.

    One automaton of all passages reads each text once, in Arrow batches; texts
    are neither shuffled nor copied. Lower case is Spark's on both sides.
    """
    known: dict[str, list] = {}
    for item, text in passage_list(passages.select("item_id", F.lower("text").alias("text"))):
        known.setdefault(text, []).append(item)
    types = {c: f.schema[c].dataType.simpleString() for f, c in ((docs, "doc_id"), (passages, "item_id"))}

    def run(batches):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for text, items in known.items():
            if text:
                automaton.add_word(text, (len(text), items))
        automaton.make_automaton()
        for batch in batches:
            rows = []
            for doc, body in zip(batch["doc_id"], batch["body"], strict=True):
                first = {i: 1 for i in known.get("", ())} if body is not None else {}
                for end, (n, items) in automaton.iter(body) if body and len(automaton) else ():
                    for i in items:
                        first.setdefault(i, end - n + 2)
                rows += [(doc, i, at) for i, at in first.items()]
            if rows:
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "position"])

    return docs.select("doc_id", F.lower("text").alias("body")).mapInPandas(run, f"doc_id {types['doc_id']}, item_id {types['item_id']}, position int")


@query()
def evidence_alignment(spark, sf):
    """Status and offsets of each passage in the texts that hold it, literally or nearly so."""
    return aligned_passages(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def aligned_passages(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """(doc_id, item_id, status, field, start, end) of passages in whole texts; passages are a bounded list.

    The list goes to every task, so texts are neither shuffled nor copied.
    """
    known = passage_list(passages)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {passages.schema['item_id'].dataType.simpleString()}, status string, field string, start int, end int"

    def run(batches):
        own = T.Passages(known)  # once a task
        for batch in batches:
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                rows = [(doc, *x) for x in own.found(text or "")]
                if rows:
                    yield pd.DataFrame(rows, columns=["doc_id", "item_id", "status", "field", "start", "end"]).astype({"start": "Int32", "end": "Int32"})

    return docs.select("doc_id", "text").mapInPandas(run, schema)


@query("""
    WITH w AS (SELECT doc_id, lang, unnest(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}_]+'), lambda t: regexp_full_match(t, '\\p{L}{3,}'))) AS term FROM documents),
    pd AS (SELECT term, lang, doc_id, count(*) AS f FROM w GROUP BY ALL), cells AS (SELECT term, lang, sum(f) AS f, count(*) AS d FROM pd GROUP BY ALL),
    fr AS (SELECT term, sum(f) AS total FROM cells GROUP BY term HAVING sum(d) >= 3), kept AS (SELECT c.*, total FROM cells c JOIN fr USING (term)),
    tot AS (SELECT lang, sum(f) AS n FROM kept GROUP BY lang), mean AS (SELECT avg(n) AS mean FROM tot), s AS (SELECT lang, term, round(f / n * ln(1 + mean / total), 8) AS weight FROM kept JOIN tot USING (lang), mean)
    SELECT lang, term, weight, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY weight DESC, term) AS r FROM s) WHERE r <= 15
""")
def ctfidf_top_terms(spark, sf):
    w = terms.class_tfidf(table(spark, sf, "documents"), "doc_id", "lang", "text", stop=[], pairs=False).withColumn("weight", F.round("weight", 8))
    return R.top_per_group(w, ["lang"], [F.desc("weight"), F.col("term")], 15).select("lang", "term", "weight", "rank")


@query()
def ctfidf_keywords(spark, sf):
    return terms.keywords(terms.class_tfidf(table(spark, sf, "documents"), "doc_id", "lang", "text"), "lang")


@query("SELECT page_id, nullif(lower(regexp_extract(url, '^https?://([^/]+)', 1)), '') AS host, CASE WHEN regexp_matches(url, '^https?://[^\\s]+$') THEN url END AS url FROM pages")
def safe_urls(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.nullif(F.lower(F.regexp_extract("url", "^https?://([^/]+)", 1)), F.lit("")).alias("host"), T.safe_url(F.col("url")).alias("url"))


# ---- vectors --------------------------------------------------------------------------------


@query("""
    WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
    s AS (SELECT q.vec_id AS query, d.vec_id AS neighbour, round(list_cosine_similarity(q.v, d.v), 6) AS similarity FROM e q JOIN e d ON q.vec_id <> d.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, neighbour) AS r FROM s)
    SELECT query, neighbour, similarity, CAST(r AS INTEGER) AS rank FROM r WHERE r <= 5
""")
def knn_cosine(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return vectors.nearest(e, e, "vec_id", "embedding", 5, places=6)


@query("""
    WITH x AS (SELECT label, vec_id, unnest(embedding) AS x, unnest(range(64)) AS i, embedding FROM embeddings), m AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS x FROM x GROUP BY ALL),
    c AS (SELECT label, list(x ORDER BY i) AS c FROM m GROUP BY label),
    s AS (SELECT label, vec_id, round(list_cosine_similarity(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), c), 6) AS similarity FROM embeddings JOIN c USING (label))
    SELECT label, vec_id, similarity, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY similarity DESC, vec_id) AS r FROM s) WHERE r <= 5
""")
def representatives(spark, sf):
    return vectors.representatives(table(spark, sf, "embeddings"), "label", "vec_id", "embedding", places=6).select("label", "vec_id", "similarity", "rank")


@query("""
    WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN NULL ELSE label END AS label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
    s AS (SELECT q.vec_id AS query, d.vec_id AS neighbour, d.label, round(list_cosine_similarity(q.v, d.v), 6) AS similarity FROM e q JOIN e d ON q.vec_id <> d.vec_id WHERE q.label IS NULL),
    r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, neighbour) AS r FROM s),
    v AS (SELECT query, label, round(sum(similarity), 9) AS w, count(*) AS n FROM r WHERE r <= 10 AND label IS NOT NULL GROUP BY ALL)
    SELECT query AS vec_id, label FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY w DESC, label) AS k FROM v) WHERE k = 1 AND n >= 3
""")
def reassign_noise(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 != 0, F.col("label")))
    near = vectors.nearest(e.where("label IS NULL"), e, "vec_id", "embedding", 10, places=6)
    return vectors.reassign(near, e, "vec_id", "label")


@query("""
    WITH p AS (SELECT label, vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings),
    d AS (SELECT a.label, a.vec_id, round(sum(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)), 6) AS d FROM p a JOIN p b USING (label) GROUP BY ALL)
    SELECT label, min_by(vec_id, d) AS vec_id FROM d GROUP BY label
""")
def medoids(spark, sf):
    e = table(spark, sf, "embeddings").select("label", "vec_id", F.col("embedding")[0].alias("x"), F.col("embedding")[1].alias("y"))
    return vectors.medoids(e, "label", "vec_id", "x", "y")


@query()
def macro_themes(spark, sf):
    return vectors.ward(table(spark, sf, "embeddings"), "label", "embedding")


@query("""
    WITH n AS (SELECT label, count(*) AS n FROM embeddings WHERE vec_id % 4 <> 0 GROUP BY label HAVING count(*) >= 35), k AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS new FROM n)
    SELECT vec_id, CAST(CASE WHEN vec_id % 4 <> 0 THEN coalesce(new, -1) ELSE -1 END AS INTEGER) AS label FROM embeddings LEFT JOIN k USING (label)
""")
def dissolved_cores(spark, sf):
    e = table(spark, sf, "embeddings")
    return vectors.dissolve_small(e, "vec_id", "label", 35, e.where("vec_id % 4 = 0"))


@query()
def density_clusters(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return vectors.density_clusters(vectors.nearest(e, e, "vec_id", "embedding", 5), e, "vec_id", 0.3, 3, 10)


@query()
def principal_axes(spark, sf):
    return vectors.principal_axes(table(spark, sf, "embeddings"), "vec_id", "embedding")


# ---- citations and resolution -------------------------------------------------------------------

REFERENCES = """
    docs AS (SELECT o_orderkey AS doc, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 500 END AS work, year(o_orderdate) AS year FROM orders),
    firsts AS (SELECT min(doc) AS doc, work FROM docs WHERE work IS NOT NULL GROUP BY work),
    named AS (SELECT d.doc, f.work, d.year FROM docs d LEFT JOIN firsts f USING (doc)),
    refs AS (SELECT DISTINCT l_orderkey AS doc, l_partkey % 700 AS cited FROM lineitem)
"""


def reference_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """References and documents of all orders."""
    d = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") % 500).alias("work"), F.year("o_orderdate").alias("year"))
    first = d.where("work IS NOT NULL").groupBy("work").agg(F.min("doc").alias("doc"))
    docs = d.drop("work").join(first, "doc", "left")
    refs = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc"), (F.col("l_partkey") % 700).alias("cited"))
    return refs, docs


@query(f"""
    WITH {REFERENCES} SELECT r.doc, r.cited, c.doc AS cited_doc, CASE WHEN c.doc IS NULL THEN 'external' WHEN c.doc = r.doc THEN 'self' WHEN c.year > d.year + 1 THEN 'anachronic' ELSE 'internal' END AS kind
    FROM refs r JOIN named d ON d.doc = r.doc LEFT JOIN named c ON c.work = r.cited
""")
def citation_split(spark, sf):
    return citations.split_references(*reference_tables(spark, sf))


@query(f"""
    WITH {REFERENCES}, n AS (SELECT doc, count(*) AS n FROM refs GROUP BY doc) SELECT doc, CASE WHEN work IS NULL THEN -1 ELSE coalesce(n, 0) END AS n_references FROM named LEFT JOIN n USING (doc)
""")
def reference_counts(spark, sf):
    refs, docs = reference_tables(spark, sf)
    return citations.coverage(docs, refs)


@query("""
    SELECT c.n_name AS source, s.n_name AS target, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation c ON c.n_nationkey = c_nationkey JOIN nation s ON s.n_nationkey = s_nationkey GROUP BY ALL
""")
def flow_matrix(spark, sf):
    nations = table(spark, sf, "nation")
    who = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("key"), F.col("n_name").alias("group"))
    whom = table(spark, sf, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("key"), F.col("n_name").alias("group"))
    links = table(spark, sf, "lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("doc"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("cited_doc"))
    return citations.flow(links, who.unionByName(whom))


@query("""
    WITH c AS (SELECT DISTINCT l_orderkey AS doc, l_partkey AS record FROM lineitem), w AS (SELECT p_partkey AS record, p_partkey % 50 AS work, p_size AS citations FROM part),
    j AS (SELECT * FROM c JOIN w USING (record)), k AS (SELECT work, count(DISTINCT doc) AS citers FROM j GROUP BY work),
    m AS (SELECT work, record, row_number() OVER (PARTITION BY work ORDER BY count(*) DESC, max(citations) DESC, record) AS r FROM j GROUP BY work, record)
    SELECT record AS work, citers, CAST(row_number() OVER (ORDER BY citers DESC, record) AS INTEGER) AS rank FROM k JOIN m USING (work) WHERE r = 1
""")
def canon(spark, sf):
    """A top-k report; there are fewer works than its limit here."""
    c = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_partkey").alias("cited"))
    w = table(spark, sf, "part").select(F.col("p_partkey").alias("record"), (F.col("p_partkey") % 50).alias("work"), F.col("p_name").alias("title"), F.col("p_size").alias("citations"))
    return citations.canon(c, w)


@query("""
    WITH a AS (SELECT c_custkey AS k, c_name AS t FROM customer), b AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 10 = 0 THEN left(c_name, 17) ELSE c_name END AS t FROM customer)
    SELECT a.k AS left, b.k AS right FROM a JOIN b ON a.t = b.t OR (least(length(a.t), length(b.t)) >= 15 AND (starts_with(a.t, b.t) OR starts_with(b.t, a.t)))
""")
def title_prefix_join(spark, sf):
    """Names of customers with the same names, a tenth of them cut."""
    p = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("t"))
    cut = p.withColumn("t", F.when(F.col("k") % 10 == 0, F.substring("t", 1, 17)).otherwise(F.col("t")))
    return citations.title_matches(p, cut, "t", "k")


@query("""
    WITH k AS (SELECT doc_id, doc_id % 2 AS half, lang, trim(regexp_replace(lower(regexp_replace(strip_accents(text), '[^\\x00-\\x7F]', '', 'g')), '[^a-z0-9]+', ' ', 'g')) AS key FROM documents),
    f AS (SELECT *, CASE WHEN length(key) >= 20 THEN first_value(doc_id) OVER (PARTITION BY key, lang ORDER BY half, doc_id) ELSE doc_id END AS first FROM k),
    p AS (SELECT doc_id, half, first, first % 2 AS other FROM f)
    SELECT 'd' || lpad(CAST(doc_id AS VARCHAR), 10, '0') AS id, 'd' || lpad(CAST(CASE WHEN half <> other THEN first ELSE doc_id END AS VARCHAR), 10, '0') AS kept, CASE WHEN half = other AND first <> doc_id THEN 'd' || lpad(CAST(first AS VARCHAR), 10, '0') END AS suspected FROM p
""")
def deduplicated_documents(spark, sf):
    """Documents of one language merge across sources when their whole texts have the same title key."""
    d = table(spark, sf, "documents").select(
        F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 10, "0")).alias("id"),
        F.when(F.col("doc_id") % 2 == 0, "first").otherwise("second").alias("source"),
        F.lit(None).cast("string").alias("pid"),
        F.lit(None).cast("string").alias("doi"),
        F.lit(2020).alias("year"),
        F.col("text").alias("title"),
        F.col("lang").alias("surname"),
    )
    return resolve.deduplicate(d, "first")


@query("""
    SELECT s_suppkey AS id, min(s_suppkey) OVER (PARTITION BY s_nationkey, lower(regexp_replace(s_name, '[^A-Za-z]+', ' ', 'g'))) AS class, list_filter([s_suppkey], lambda x: false) AS compatible FROM supplier
""")
def name_block_classes(spark, sf):
    """All suppliers, whose names of a nation are equal, as classes with members instead of pairs."""
    s = table(spark, sf, "supplier").select("s_suppkey", F.concat_ws(" ", F.regexp_replace("s_name", "[^A-Za-z]+", " "), F.concat(F.lit("n"), F.translate(F.col("s_nationkey").cast("string"), "0123456789", "abcdefghij"))).alias("name"))
    return resolve.name_classes(s, "s_suppkey", "name")


@query("""
    WITH c AS (SELECT l_orderkey AS doc, l_partkey AS candidate, p_brand AS parent, l_extendedprice AS score FROM lineitem JOIN part ON l_partkey = p_partkey),
    b AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY score DESC, candidate, parent) AS r FROM c), t AS (SELECT * FROM b WHERE r = 1),
    v AS (SELECT c.doc, max(c.score) AS rival FROM c JOIN t ON c.doc = t.doc WHERE c.parent <> t.parent GROUP BY 1)
    SELECT doc, candidate, score FROM t LEFT JOIN v USING (doc) WHERE rival IS NULL OR score - rival >= 1000
""")
def best_with_margin(spark, sf):
    c = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("doc"), F.col("l_partkey").alias("candidate"), F.col("p_brand").alias("parent"), F.col("l_extendedprice").alias("score"))
    return R.best_with_margin(c, ["doc"], "candidate", "parent", "score", 1000.0)


# ---- SQL that users may run --------------------------------------------------------------------


@query("SELECT c_mktsegment, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY CUBE (c_mktsegment, o_orderpriority)")
def cube_of_orders(spark, sf):
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.cube("c_mktsegment", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""
    SELECT o_custkey, o_orderkey, CAST(rank() OVER w AS INTEGER) AS rank, lag(o_orderkey) OVER w AS previous, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS moving
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
""")
def window_functions(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.rank().over(w).alias("rank"), F.lag("o_orderkey").over(w).alias("previous"), F.round(F.sum("o_totalprice").over(w.rowsBetween(-2, 0)), 2).alias("moving"))


@query("SELECT l_shipmode FROM (SELECT l_returnflag AS l_shipmode FROM lineitem EXCEPT SELECT l_linestatus FROM lineitem) UNION ALL SELECT x FROM (SELECT l_returnflag AS x FROM lineitem INTERSECT SELECT l_returnflag FROM lineitem)")
def set_operations(spark, sf):
    lines = table(spark, sf, "lineitem")
    flags, status = lines.select(F.col("l_returnflag").alias("l_shipmode")), lines.select(F.col("l_linestatus").alias("l_shipmode"))
    return flags.subtract(status).unionAll(flags.intersect(flags))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_events(spark, sf):
    from quillspark.streaming.jobs import windowed_counts

    return windowed_counts(table(spark, sf, "events"), "ts", ["event_type"]).select("start", "event_type", "n")


@query("""
    WITH f AS (SELECT event_id, user_id, ts, CASE WHEN ts - lag(ts) OVER w > INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM f) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s
""")
def session_events(spark, sf):
    from quillspark.streaming.jobs import sessions

    return sessions(table(spark, sf, "events"), "ts", "user_id").select("user_id", "start", "n")


@query("""
    SELECT CAST(year(o_orderdate) AS INTEGER) AS year, c_mktsegment IN ('BUILDING', 'MACHINERY') AS member, round(avg(CAST(o_orderstatus = 'F' AS INT)), 6) AS share FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL
""")
def share_by_membership(spark, sf):
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy(F.year("o_orderdate").alias("year"), F.col("c_mktsegment").isin("BUILDING", "MACHINERY").alias("member")).agg(F.round(F.avg((F.col("o_orderstatus") == "F").cast("int")), 6).alias("share"))


@query("""
    WITH s AS (SELECT c_mktsegment, count(*) FILTER (WHERE year(o_orderdate) < 1998) AS n1, count(*) FILTER (WHERE year(o_orderdate) < 1998 AND o_orderpriority = '1-URGENT') AS k1,
        count(*) FILTER (WHERE year(o_orderdate) >= 1998) AS n2, count(*) FILTER (WHERE year(o_orderdate) >= 1998 AND o_orderpriority = '1-URGENT') AS k2 FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)
    SELECT c_mktsegment, abs(k1 / n1 - k2 / n2) > 1.959963984540054 * sqrt((k1 + k2) / (n1 + n2) * (1 - (k1 + k2) / (n1 + n2)) * (1 / n1 + 1 / n2)) AS differs FROM s
""")
def period_difference(spark, sf):
    late, urgent = F.year("o_orderdate") >= 1998, F.col("o_orderpriority") == "1-URGENT"
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    s = rows.groupBy("c_mktsegment").agg(F.count_if(~late).alias("n1"), F.count_if(~late & urgent).alias("k1"), F.count_if(late).alias("n2"), F.count_if(late & urgent).alias("k2"))
    return s.select("c_mktsegment", S.differ(F.col("k1"), F.col("n1"), F.col("k2"), F.col("n2")).alias("differs"))


@query("""
    WITH p AS (SELECT c_mktsegment, o_orderpriority, avg(CAST(year(o_orderdate) >= 1998 AS INT)) AS late FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
    SELECT c_mktsegment, o_orderpriority, round(late, 6) AS late FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY round(late, 9) DESC, o_orderpriority) AS r FROM p) WHERE r = 1
""")
def most_recent_category(spark, sf):
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    p = rows.groupBy("c_mktsegment", "o_orderpriority").agg(F.avg((F.year("o_orderdate") >= 1998).cast("int")).alias("late"))
    return R.top_per_group(p, ["c_mktsegment"], [F.round("late", 9).desc(), F.col("o_orderpriority")], 1).select("c_mktsegment", "o_orderpriority", F.round("late", 6).alias("late"))


@query("""
    WITH s AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, c_mktsegment, avg(CAST(o_orderstatus <> 'F' AS INT)) AS share FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
    b AS (SELECT c_mktsegment, max(year) FILTER (WHERE share < 0.3) AS b FROM s GROUP BY 1) SELECT c_mktsegment, min(year) FILTER (WHERE b IS NULL OR year > b) AS since FROM s JOIN b USING (c_mktsegment) GROUP BY 1
""")
def always_since(spark, sf):
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    s = rows.groupBy(F.year("o_orderdate").alias("year"), "c_mktsegment").agg(F.avg((F.col("o_orderstatus") != "F").cast("int")).alias("share"))
    return R.always_since(s, ["c_mktsegment"], "year", "share", 0.3)


@query("""
    WITH o AS (SELECT c_mktsegment, o_orderpriority, CAST(year(o_orderdate) >= 1998 AS INT) AS late FROM orders JOIN customer ON o_custkey = c_custkey),
    k AS (SELECT c_mktsegment, o_orderpriority, sum(1 - late) AS k0, sum(late) AS k1 FROM o GROUP BY ALL), n AS (SELECT c_mktsegment, sum(1 - late) AS n0, sum(late) AS n1 FROM o GROUP BY 1),
    s AS (SELECT c_mktsegment, o_orderpriority, k0 / n0 AS before, k1 / n1 AS after FROM k JOIN n USING (c_mktsegment))
    SELECT c_mktsegment, o_orderpriority, round(before, 6) AS before, round(after, 6) AS after FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY round(abs(after - before), 9) DESC, o_orderpriority) AS r FROM s) WHERE r = 1
""")
def largest_change(spark, sf):
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    out = R.largest_change(rows, F.year("o_orderdate") >= 1998, "o_orderpriority", "c_mktsegment")
    return out.select("c_mktsegment", "o_orderpriority", F.round("before", 6).alias("before"), F.round("after", 6).alias("after"))


@query("""
    WITH s AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority AS key, count(*) AS n FROM orders GROUP BY ALL), c AS (SELECT *, sum(n) OVER (PARTITION BY year ORDER BY key) AS high, sum(n) OVER (PARTITION BY year) AS total FROM s)
    SELECT year, key, round((high - n) / total, 6) AS low, round(high / total, 6) AS high FROM c
""")
def stacked_shares(spark, sf):
    s = table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return R.stacked(s, "year", "key", "n", [F.col("key")], expand=True).select("year", "key", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query(f"""
    WITH {VOTES}, long AS (SELECT doc_id, 'a' AS rater, a AS v FROM votes UNION ALL SELECT doc_id, 'b', b FROM votes UNION ALL SELECT doc_id, 'c', c FROM votes)
    SELECT x.doc_id, x.rater AS rater_a, y.rater AS rater_b, CAST(x.v AS VARCHAR) AS a, CAST(y.v AS VARCHAR) AS b FROM long x JOIN long y ON x.doc_id = y.doc_id AND x.rater < y.rater WHERE x.v <> y.v
""")
def divergences(spark, sf):
    b = ballots(spark, sf)
    return S.divergences(S.rater_pairs(b, ["doc_id"], "member", "value")).select("doc_id", "rater_a", "rater_b", "a", "b")


@query("""
    WITH k AS (SELECT doc_id AS key, lang AS label, 1 AS source FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 'manual', 0 FROM documents WHERE doc_id % 5 = 0)
    SELECT d.doc_id, r.label, r.source FROM documents d LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY key ORDER BY source) AS r FROM k) r ON r.key = d.doc_id AND r.r = 1
""")
def labels_by_precedence(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("label"))
    return R.by_precedence(d, [d.where("doc_id % 5 = 0").withColumn("label", F.lit("manual")), d.where("doc_id % 2 = 0")], "doc_id", "label")


@query()
def spanning_tree(spark, sf):
    return vectors.spanning_tree(table(spark, sf, "embeddings"), "label", "embedding")


from . import record_queries  # noqa: E402, F401  registers its queries
