"""Filters, audits and upkeep reads over the test tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import pages as P
from tessera.operators import upkeep as U
from tessera.plans.registry import query, table


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderdate >= TIMESTAMP '1996-01-01' - INTERVAL 730 DAY AND o_orderdate <= TIMESTAMP '1995-12-31 23:59:59.999999'")
def chunk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk filters with relative and plain date boundaries; they reach the scan."""
    now = dt.datetime(1996, 1, 1)
    o = table(spark, sf_dir, "orders").withColumns({"language": F.col("o_orderstatus"), "effective_date": F.lit(None).cast("timestamp_ntz"), "updated_at": F.col("o_orderdate")})
    since, until = U.date_boundary("2y", "since", now), U.date_boundary("1995-12-31", "until", now)
    return U.chunk_filters(o, languages=["F", "O"], since=since, until=until).select("o_orderkey", "o_orderpriority")


@query("SELECT p_partkey AS id FROM part WHERE p_brand LIKE '%1%' AND contains(lower(p_type), 'small') AND p_retailprice >= 950")
def fact_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts by optional conditions."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("kind"), F.col("p_type").alias("fact"), F.col("p_retailprice").alias("confidence"), F.lit(None).cast("date").alias("written_at"))
    return U.list_facts(p, kinds=F.col("kind").contains("1"), text="sMall", least_confidence=950).select("id")


@query("SELECT 'doc_' || substr(sha256(p_name), 1, 16) AS id, p_name AS path FROM part WHERE p_size = 7")
def document_id_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose id does not follow from their path."""
    p = table(spark, sf_dir, "part")
    right = F.concat(F.lit("doc_"), F.substring(F.sha2("p_name", 256), 1, 16))
    drifted = U.id_drift(p.select(F.when(F.col("p_size") == 7, F.concat(right, F.lit("x"))).otherwise(right).alias("id"), F.col("p_name").alias("path")), "id", "path")
    return drifted.select(F.substring("id", 1, 20).alias("id"), "path")


@query("SELECT c_custkey AS slug FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = c.c_mktsegment) AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '2-HIGH')")
def pages_to_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two anti joins: neither done nor running."""
    o = table(spark, sf_dir, "orders")
    pages = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("slug"), F.col("c_mktsegment").alias("content_hash"), F.lit(1).alias("version"))
    done = o.select(F.col("o_custkey").alias("slug"), F.col("o_orderstatus").alias("content_hash"), F.lit(1).alias("version"))
    return U.pages_to_scan(pages, done, o.where("o_orderpriority = '2-HIGH'").select(F.col("o_custkey").alias("slug"))).select("slug")


@query("SELECT c_mktsegment AS source, count(DISTINCT c_custkey) AS documents, count(DISTINCT o_orderkey) AS chunks, count(DISTINCT l_orderkey * 10 + l_linenumber) AS mentions FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def delete_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct counts over a chain of left joins."""
    d = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document_id"), F.col("c_mktsegment").alias("source"))
    c = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("chunk_id"))
    m = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("mention_id"))
    return U.delete_impact(d, c, m, "source")


@query("""WITH t AS (SELECT DISTINCT p_type, list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower(p_type), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))) AS g FROM part),
q AS (SELECT list_distinct(flatten(list_transform(['small', 'steel'], lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))) AS h),
s AS (SELECT p_type, len(list_intersect(g, h)) / (len(g) + len(h) - len(list_intersect(g, h))) AS s FROM t, q) SELECT p_type, round(s, 6) AS similarity FROM s WHERE s >= 0.3 OR contains(lower(p_type), 'small steel')""")
def take_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fuzzy search by trigrams or containment."""
    return U.fuzzy_search(table(spark, sf_dir, "part").select("p_type").distinct(), "small steel", "p_type").select("p_type", F.round("similarity", 6).alias("similarity"))


@query("""WITH k AS (SELECT json_extract_string(props, '$.k') AS key, ts, event_id FROM events), c AS (SELECT key, count(*) AS n FROM k WHERE key IS NOT NULL GROUP BY 1 ORDER BY n DESC, key LIMIT 5),
r AS (SELECT k.*, n, row_number() OVER (PARTITION BY key ORDER BY ts DESC, event_id) AS i FROM k JOIN c USING (key)) SELECT key, n, list(event_id ORDER BY i) AS samples FROM r WHERE i <= 3 GROUP BY 1, 2""")
def friction_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent keys of a JSON column with their latest samples."""
    return U.top_with_samples(table(spark, sf_dir, "events"), F.get_json_object("props", "$.k"), "ts", "event_id", 5)


@query("SELECT user_id, count(*) AS total, count(*) FILTER (CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events)) AS today FROM events GROUP BY 1")
def token_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of the last day against all."""
    e = table(spark, sf_dir, "events")
    last = e.agg(F.max(F.to_date("ts")).alias("last"))
    return e.crossJoin(F.broadcast(last)).groupBy("user_id").agg(F.count("*").alias("total"), F.count_if(F.to_date("ts") == F.col("last")).alias("today"))


@query("SELECT event_id, hour(timezone('Europe/Berlin', timezone('UTC', ts))) BETWEEN 6 AND 7 AS quiet, hour(timezone('Europe/Berlin', timezone('UTC', ts))) >= 22 OR hour(timezone('Europe/Berlin', timezone('UTC', ts))) < 6 AS night FROM events")
def quiet_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quiet hours of a zone, also over midnight."""
    at = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", U.quiet(at).alias("quiet"), U.quiet(at, 22, 6).alias("night"))


@query("""WITH g AS (SELECT o_custkey AS take, o_orderkey AS grade_id, o_custkey % 8 AS source, (['correct','incorrect','partial'])[o_orderkey % 3 + 1] AS verdict FROM orders),
l AS (SELECT take, source, arg_max(verdict, grade_id) AS verdict FROM g GROUP BY 1, 2)
SELECT source, count(*) AS graded, round((count(*) FILTER (verdict = 'correct') + 0.5 * count(*) FILTER (verdict = 'partial')) / count(*), 6)::DOUBLE AS accuracy FROM l GROUP BY 1 HAVING count(*) >= 5""")
def calibration_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy by source from the latest grades."""
    verdict = F.element_at(F.array(F.lit("correct"), F.lit("incorrect"), F.lit("partial")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    g = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("take"), F.col("o_orderkey").alias("grade_id"), (F.col("o_custkey") % 8).alias("source"), verdict.alias("verdict"))
    return U.calibration_profiles(g).withColumn("accuracy", F.round("accuracy", 6))


@query("SELECT 'customer' AS t, c_nationkey AS source, count(*) AS n FROM customer GROUP BY 2 UNION ALL SELECT 'supplier', s_nationkey, count(*) FROM supplier GROUP BY 2")
def source_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each table that refer to a source."""
    refs = [(t, c) for t, c in (("customer", "c_nationkey"), ("supplier", "s_nationkey"))]
    parts = [table(spark, sf_dir, t).groupBy(F.col(c).alias("source")).agg(F.count("*").alias("n")).select(F.lit(t).alias("t"), "source", "n") for t, c in refs]
    return parts[0].unionAll(parts[1])


@query("""WITH p AS (SELECT doc_id AS slug, source AS source_id, md5(text) AS h, lang AS title FROM documents), m AS (SELECT slug, source_id, CASE WHEN slug % 5 = 0 THEN 'x' ELSE h END AS h, title, CASE WHEN slug % 7 = 0 THEN 1 ELSE 2 END AS v FROM p WHERE slug % 11 <> 0)
SELECT p.slug FROM p LEFT JOIN m USING (slug) WHERE m.slug IS NULL OR m.h <> p.h OR m.v < 2""")
def mirror_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose search mirror is missing or stale."""
    p = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("slug"), F.col("source").alias("source_id"), F.md5("text").alias("content_hash"), F.col("lang").alias("title"), F.lit(None).cast("timestamp").alias("updated_at"))
    m = p.where("slug % 11 <> 0").withColumns({"content_hash": F.when(F.col("slug") % 5 == 0, "x").otherwise(F.col("content_hash")), "chunker_version": F.when(F.col("slug") % 7 == 0, 1).otherwise(2)})
    return P.stale_mirrors(p, m, 2).select("slug")


@query("(SELECT 'out' AS direction, n_name AS name FROM nation ORDER BY n_name LIMIT 5) UNION ALL (SELECT 'in', r_name FROM region ORDER BY r_name DESC LIMIT 2)")
def limited_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A union of limited branches."""
    out = table(spark, sf_dir, "nation").select(F.lit("out").alias("direction"), F.col("n_name").alias("name")).orderBy("name").limit(5)
    return out.unionAll(table(spark, sf_dir, "region").select(F.lit("in"), F.col("r_name").alias("name")).orderBy(F.desc("name")).limit(2))


@query("SELECT count(DISTINCT doc_id) AS documents, count(DISTINCT doc_id) FILTER (quality IS NOT NULL) AS labelled, count(DISTINCT source) AS sources, max(n_chars) AS longest FROM documents LEFT JOIN labels USING (doc_id)")
def corpus_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of the whole corpus in one row."""
    j = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return j.agg(F.countDistinct("doc_id").alias("documents"), F.countDistinct(F.when(F.col("quality").isNotNull(), F.col("doc_id"))).alias("labelled"), F.countDistinct("source").alias("sources"), F.max("n_chars").alias("longest"))


@query("SELECT lower(trim(p_name)) AS q, count(*) AS n, min(p_partkey) AS first_id FROM part GROUP BY 1 HAVING count(*) > 1")
def repeated_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions asked more than once."""
    return table(spark, sf_dir, "part").groupBy(F.lower(F.trim("p_name")).alias("q")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_id")).where("n > 1")


@query("SELECT event_type AS intent, count(*) FILTER (value >= 50) AS fresh, count(*) FILTER (value < 50) AS stale, count(DISTINCT user_id) AS users, min(ts) AS oldest, max(ts) AS newest FROM events GROUP BY 1")
def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fresh and stale entries of a cache."""
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("intent")).agg(F.count_if(F.col("value") >= 50).alias("fresh"), F.count_if(F.col("value") < 50).alias("stale"), F.countDistinct("user_id").alias("users"), F.min("ts").alias("oldest"), F.max("ts").alias("newest"))


@query(r"""SELECT conv_id, turn, regexp_extract_all(text, '@([A-Za-z0-9_]{2,})', 1) AS handles FROM conversations""")
def turn_handles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Handles in turns."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.regexp_extract_all("text", F.lit("@([A-Za-z0-9_]{2,})"), 1).alias("handles"))


@query()
def turn_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capitalised candidates of turns."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.capitalised_candidates(F.col("text")).alias("candidates"))
