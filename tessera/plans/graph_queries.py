"""Link graphs, joins and name resolution over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import graph as G
from tessera.plans.registry import query, table

EDGES_SQL = "WITH e AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst, CASE WHEN l_linenumber = 7 THEN 'mention' ELSE 'supplies' END AS type FROM lineitem)"
TREE_SQL = """e AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier
UNION ALL SELECT DISTINCT 's' || l_suppkey, 'p' || l_partkey FROM lineitem)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers linked to parts; links of seventh lines are mentions."""
    kind = F.when(F.col("l_linenumber") == 7, "mention").otherwise("supplies")
    return table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"), kind.alias("type")).distinct()


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions to nations to suppliers to parts."""
    n, s, li = (table(spark, sf_dir, t) for t in ("nation", "supplier", "lineitem"))
    return (
        n.select(F.concat(F.lit("r"), "n_regionkey").alias("src"), F.concat(F.lit("n"), "n_nationkey").alias("dst"))
        .unionAll(s.select(F.concat(F.lit("n"), "s_nationkey"), F.concat(F.lit("s"), "s_suppkey")))
        .unionAll(li.select(F.concat(F.lit("s"), "l_suppkey"), F.concat(F.lit("p"), "l_partkey")).distinct())
    )


@query("WITH RECURSIVE " + TREE_SQL + """, w AS (SELECT 'r1' AS node, 0 AS depth UNION SELECT e.dst, w.depth + 1 FROM w JOIN e ON e.src = w.node WHERE w.depth < 3)
SELECT 'r1' AS seed, node, min(depth) AS depth FROM w GROUP BY node""")
def graph_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breadth-first walk with least depths."""
    return G.traverse(tree(spark, sf_dir), spark.createDataFrame([("r1",)], "node string"), 3)


@query("WITH " + TREE_SQL + ", b AS (SELECT src AS node, dst AS neighbour, 'out' AS direction FROM e UNION ALL SELECT dst, src, 'in' FROM e) SELECT * FROM b WHERE node = 'n3'")
def graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of a node in both directions."""
    return G.neighbours(tree(spark, sf_dir), "n3")


@query("WITH RECURSIVE " + TREE_SQL + """, a AS (SELECT 'n1' AS node, 0 AS depth UNION SELECT e.dst, a.depth + 1 FROM a JOIN e ON e.src = a.node WHERE a.depth < 2),
b AS (SELECT 'n2' AS node, 0 AS depth UNION SELECT e.dst, b.depth + 1 FROM b JOIN e ON e.src = b.node WHERE b.depth < 2),
ma AS (SELECT node, min(depth) AS d FROM a GROUP BY 1), mb AS (SELECT node, min(depth) AS d FROM b GROUP BY 1)
SELECT node, ma.d + mb.d AS depth FROM ma JOIN mb USING (node)""")
def graph_connects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that two walks share."""
    e = tree(spark, sf_dir)
    walk = lambda n: G.traverse(e, spark.createDataFrame([(n,)], "node string"), 2)
    return G.connecting(walk("n1"), walk("n2"))


@query(EDGES_SQL + " SELECT dst AS node, count(DISTINCT src) AS n FROM e WHERE src <> dst AND type <> 'mention' GROUP BY 1")
def backlinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct linking pages of each page."""
    return G.backlink_counts(edges(spark, sf_dir))


@query(EDGES_SQL + ", u AS (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) SELECT node, count(*) AS degree FROM u GROUP BY 1")
def link_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links at either end of each page."""
    return G.degrees(edges(spark, sf_dir))


@query(EDGES_SQL + """, u AS (SELECT src AS node, dst AS x FROM e UNION ALL SELECT dst, src FROM e), d AS (SELECT node, count(DISTINCT x) AS degree FROM u GROUP BY 1)
SELECT 's' || s_suppkey AS node, coalesce(degree, 0) AS degree FROM supplier LEFT JOIN d ON d.node = 's' || s_suppkey ORDER BY degree DESC, node LIMIT 20""")
def experts_by_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with most distinct neighbours."""
    pages = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node"), F.lit(None).cast("timestamp").alias("updated_at"))
    return G.experts(edges(spark, sf_dir), pages, 20).drop("updated_at")


@query("""WITH h AS (SELECT o_custkey AS node, max(o_totalprice / 1000) AS score, max(o_orderdate) AS updated_at, max((o_custkey % 10) / 10.0) AS salience FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1)
SELECT node, round(ln(1 + score) * greatest(0.1, exp(-date_diff('day', CAST(updated_at AS DATE), DATE '2024-02-01') / 180.0)) * (0.5 + 0.5 * salience), 6) AS value FROM h ORDER BY value DESC, node LIMIT 15""")
def experts_on_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by best hit, freshness and salience."""
    o = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    hits = o.select(F.col("o_custkey").alias("node"), (F.col("o_totalprice") / 1000).alias("score"), F.col("o_orderdate").alias("updated_at"), ((F.col("o_custkey") % 10) / 10.0).alias("salience"))
    return G.experts_by_topic(hits, F.lit("2024-02-01").cast("date"), 15)


@query(EDGES_SQL + """, u AS (SELECT src AS node FROM e UNION ALL SELECT dst FROM e), d AS (SELECT node, count(*) AS degree FROM u GROUP BY 1), m AS (SELECT avg(degree) AS mean, stddev_pop(degree) AS sd FROM d)
SELECT node, degree, round((degree - mean) / sd, 5) AS z FROM d, m WHERE sd > 0 AND degree >= mean + 2 * sd""")
def degree_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with unusually many links."""
    return G.degree_anomalies(G.degrees(edges(spark, sf_dir))).withColumn("z", F.round("z", 5))


@query("""WITH p AS (SELECT c_custkey AS node, c_custkey % 10 / 10.0 AS salience, max(o_orderdate) AS updated_at FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT node, CAST(salience AS DOUBLE) AS salience, CAST(date_diff('day', CAST(updated_at AS DATE), DATE '2024-06-01') AS INTEGER) AS age_days FROM p WHERE salience >= 0.5 AND date_diff('day', CAST(updated_at AS DATE), DATE '2024-06-01') >= 90""")
def stale_salient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Salient pages without recent changes."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("updated_at"))
    p = table(spark, sf_dir, "customer").join(o, "c_custkey").select(F.col("c_custkey").alias("node"), (F.col("c_custkey") % 10 / 10.0).alias("salience"), "updated_at")
    return G.stale_salient(p, F.lit("2024-06-01").cast("date"))


@query("SELECT c_custkey AS node FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')")
def orphan_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without a finished order."""
    e = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("dst"))
    return G.orphans(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node")), e)


@query("WITH t AS (SELECT p_size, p_name || p_partkey % 2 AS target FROM part) SELECT target FROM t p WHERE NOT EXISTS (SELECT 1 FROM t q WHERE q.p_size < 2 AND lower(trim(q.target)) = lower(trim(p.target)))")
def dangling_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link targets that are no title."""
    p = table(spark, sf_dir, "part").select("p_size", F.concat("p_name", F.col("p_partkey") % 2).alias("target"))
    return G.dangling(p.select("target"), p.where("p_size < 2").select(F.col("target").alias("title")))


@query(EDGES_SQL + """, h AS (SELECT * FROM (SELECT 1 AS query_id, 's' || s_suppkey AS id FROM supplier ORDER BY s_acctbal DESC, id LIMIT 50) UNION ALL SELECT * FROM (SELECT 1, 'p' || p_partkey AS id FROM part ORDER BY p_retailprice DESC, id LIMIT 100))
SELECT 1 AS query_id, dst AS id, count(DISTINCT src) AS n FROM e WHERE src IN (SELECT id FROM h) AND dst IN (SELECT id FROM h) GROUP BY dst HAVING count(DISTINCT src) >= 2""")
def hit_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top hits that several other top hits link to."""
    s = table(spark, sf_dir, "supplier").select(F.lit(1).alias("query_id"), F.concat(F.lit("s"), "s_suppkey").alias("id"), F.col("s_acctbal").alias("score"))
    p = table(spark, sf_dir, "part").select(F.lit(1).alias("query_id"), F.concat(F.lit("p"), "p_partkey").alias("id"), F.col("p_retailprice").alias("score"))
    best = lambda df, k: df.orderBy(F.desc("score"), "id").limit(k)
    return G.adjacency(best(s, 50).unionAll(best(p, 100)), edges(spark, sf_dir), 2)


CALLS = [("d1", "a", "b"), ("d1", "b", "c"), ("d1", "c", "a"), ("d2", "c", "d"), ("d2", "d", "e"), ("d2", "x", "a")]
CALLS_SQL = "c(document_id, caller, callee) AS (VALUES ('d1','a','b'), ('d1','b','c'), ('d1','c','a'), ('d2','c','d'), ('d2','d','e'), ('d2','x','a'))"


@query("WITH RECURSIVE " + CALLS_SQL + """, w AS (SELECT 'a' AS symbol, 0 AS depth UNION SELECT c.callee, w.depth + 1 FROM w JOIN c ON c.caller = w.symbol WHERE w.depth < 5)
SELECT symbol, min(depth) AS depth, round(greatest(0.05, least(1.0, 1 / (1 + 0.3 * min(depth)))), 6)::DOUBLE AS confidence FROM w GROUP BY 1""")
def code_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Callees of a recursive call graph, with confidence by depth."""
    e = spark.createDataFrame(CALLS, "document_id string, caller string, callee string")
    return G.code_walk(e, spark.createDataFrame([("a",)], "symbol string"), 5).withColumn("confidence", F.round("confidence", 6))


@query("WITH " + CALLS_SQL + """, s(document_id, name, chunk_id) AS (VALUES ('d1','b','k1'), ('d1','c','k2'), ('d1','c','k3'), ('d2','d','k4')),
g AS (SELECT document_id, name, count(DISTINCT chunk_id) AS n, min(chunk_id) AS one FROM s GROUP BY 1, 2)
SELECT c.document_id, callee, caller, CASE WHEN n IS NULL THEN 'unresolved' WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS state, CASE WHEN n = 1 THEN one END AS chunk_id
FROM c LEFT JOIN g ON g.document_id = c.document_id AND g.name = c.callee""")
def symbol_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls resolved to chunks of the same document."""
    calls = spark.createDataFrame(CALLS, "document_id string, caller string, callee string")
    symbols = spark.createDataFrame([("d1", "b", "k1"), ("d1", "c", "k2"), ("d1", "c", "k3"), ("d2", "d", "k4")], "document_id string, name string, chunk_id string")
    return G.resolve_calls(calls, symbols).drop("chunks")


@query("""WITH s AS (SELECT o_custkey AS document_id, o_orderkey AS name, dayofyear(o_orderdate) AS start_line, dayofyear(o_orderdate) + 40 AS end_line FROM orders),
l AS (SELECT c_custkey AS document_id, c_custkey % 365 + 1 AS line FROM customer),
m AS (SELECT l.document_id, line, name, row_number() OVER (PARTITION BY l.document_id, line ORDER BY end_line - start_line, start_line, name) AS n
      FROM l JOIN s ON s.document_id = l.document_id AND line BETWEEN start_line AND end_line)
SELECT document_id, line, name FROM m WHERE n = 1""")
def symbol_at_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range join: the innermost span around a line."""
    o = table(spark, sf_dir, "orders")
    s = o.select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("name"), F.dayofyear("o_orderdate").alias("start_line"), (F.dayofyear("o_orderdate") + 40).alias("end_line"))
    lines = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document_id"), (F.col("c_custkey") % 365 + 1).alias("line"))
    return G.symbol_at_line(lines, s).select("document_id", "line", "name")


@query("""WITH s(source_id, path_prefix) AS (VALUES ('all','/'), ('europe','/EUROPE/'), ('fr','/EUROPE/FR'), ('asia','/ASIA/')),
p AS (SELECT '/' || r_name || '/' || n_name AS path FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT 'nowhere'),
m AS (SELECT path, source_id, row_number() OVER (PARTITION BY path ORDER BY length(path_prefix) DESC) AS n FROM p JOIN s ON starts_with(path, path_prefix))
SELECT p.path, source_id FROM p LEFT JOIN m ON m.path = p.path AND n = 1""")
def source_of_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest-prefix join of paths to sources."""
    s = spark.createDataFrame([("all", "/"), ("europe", "/EUROPE/"), ("fr", "/EUROPE/FR"), ("asia", "/ASIA/")], "source_id string, path_prefix string")
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    paths = table(spark, sf_dir, "nation").join(r, "n_regionkey").select(F.concat(F.lit("/"), "r_name", F.lit("/"), "n_name").alias("path"))
    return G.longest_prefix(paths.unionAll(spark.createDataFrame([("nowhere",)], "path string")), s).select("path", "source_id")


@query("""WITH n AS (SELECT lower(trim(n_name)) AS phrase, 'nation/' || n_nationkey AS slug FROM nation UNION ALL SELECT lower(trim(r_name)), 'region/' || r_regionkey FROM region)
SELECT phrase, min(slug) AS slug FROM n WHERE length(phrase) >= 3 GROUP BY 1 HAVING count(DISTINCT slug) = 1""")
def gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unambiguous names of pages."""
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.concat(F.lit("nation/"), "n_nationkey").alias("slug"))
    return G.gazetteer(n.unionAll(table(spark, sf_dir, "region").select("r_name", F.concat(F.lit("region/"), "r_regionkey"))))


@query("SELECT n_name AS name, 'nation' AS kind FROM nation UNION SELECT r_name, 'region' FROM region")
def union_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct union."""
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.lit("nation").alias("kind")).union(table(spark, sf_dir, "region").select("r_name", F.lit("region"))).distinct()


@query("(SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') UNION ALL (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def symmetric_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys in one set alone."""
    o = table(spark, sf_dir, "orders")
    f, other = (o.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k")).distinct() for s in "FO")
    return f.join(other, "k", "left_anti").unionAll(other.join(f, "k", "left_anti"))
