"""Facts, timelines, trajectories, calibration, evaluation metrics and reports over the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import rank as R
from tessera.functions import stats as M
from tessera.operators import facts as K
from tessera.operators import pages as P
from tessera.operators import reports as Q
from tessera.operators import timeline as L
from tessera.plans.registry import query, table



def day() -> Column:
    return F.lit("2024-01-20").cast("date")


def now() -> Column:
    return F.lit("2024-02-01 00:00:00").cast("timestamp")


FACTS_SQL = """WITH f AS (SELECT event_id AS id, 'u' || user_id AS entity, event_type AS dimension, CAST(CAST(floor(value) AS BIGINT) % 5 AS VARCHAR) AS value, CASE WHEN event_id % 4 = 3 THEN NULL ELSE 's' || event_id % 4 END AS source_id,
 CAST(ts AS DATE) AS valid_from, CASE WHEN event_id % 3 = 0 THEN CAST(ts AS DATE) + 10 END AS valid_until, ts AS written_at, (['event','commitment','belief','odd'])[event_id % 4 + 1] AS kind, (event_id % 10) / 10.0 AS confidence FROM events)
"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as facts of users."""
    e, n = table(spark, sf_dir, "events"), F.col("event_id")
    kind = F.element_at(F.array(*map(F.lit, ("event", "commitment", "belief", "odd"))), (n % 4 + 1).cast("int"))
    at = F.to_date("ts")
    return e.select(n.alias("id"), F.concat(F.lit("u"), "user_id").alias("entity"), F.col("event_type").alias("dimension"), (F.floor("value") % 5).cast("string").alias("value"),
                    F.when(n % 4 != 3, F.concat(F.lit("s"), n % 4)).alias("source_id"), at.alias("valid_from"), F.when(n % 3 == 0, F.date_add(at, 10)).alias("valid_until"),
                    F.col("ts").cast("timestamp").alias("written_at"), kind.alias("kind"), ((n % 10) / 10.0).alias("confidence"))


@query(FACTS_SQL + """, v AS (SELECT *, row_number() OVER (PARTITION BY entity, dimension ORDER BY valid_from DESC NULLS LAST, confidence DESC, id) AS n FROM f
 WHERE (valid_from IS NULL OR valid_from <= DATE '2024-01-20') AND (valid_until IS NULL OR DATE '2024-01-20' < valid_until)) SELECT entity, dimension, id, value FROM v WHERE n = 1""")
def ontology_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current value of each dimension on a day."""
    order = [F.desc_nulls_last("valid_from"), F.desc("confidence"), F.asc("id")]
    return K.as_of(facts(spark, sf_dir), day(), ["entity", "dimension"], order).select("entity", "dimension", "id", "value")


@query(FACTS_SQL + """SELECT id, round(CASE WHEN valid_until IS NOT NULL AND valid_until < DATE '2024-02-01' THEN 0.0 WHEN kind = 'odd' THEN confidence
 ELSE confidence * exp(-(epoch_us(TIMESTAMP '2024-02-01') - epoch_us(written_at)) / 86400000000.0 / CASE kind WHEN 'event' THEN 7 WHEN 'commitment' THEN 90 ELSE 365 END) END, 6)::DOUBLE AS confidence_now FROM f""")
def fact_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence of facts after decay."""
    return K.decayed(facts(spark, sf_dir), now()).select("id", F.round("confidence_now", 6).alias("confidence_now"))


@query(FACTS_SQL + "SELECT entity, dimension, count(DISTINCT value) AS n_values, count(DISTINCT source_id) AS n_sources FROM f GROUP BY 1, 2 HAVING count(DISTINCT value) >= 2 AND count(DISTINCT source_id) >= 2")
def ontology_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimensions with several values from several sources."""
    return K.conflicts(facts(spark, sf_dir))


@query(FACTS_SQL + """, v AS (SELECT entity, dimension, source_id, value, min(id) AS id, count(*) AS n FROM f GROUP BY ALL)
SELECT a.entity, a.dimension, a.id AS id_a, b.id AS id_b, a.n * b.n AS n_pairs FROM v a JOIN v b ON a.entity = b.entity AND a.dimension = b.dimension AND a.source_id IS NOT DISTINCT FROM b.source_id AND b.id > a.id AND a.value <> b.value""")
def contradiction_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Theta self join with null-safe tenants, over distinct values."""
    return K.contradiction_pairs(facts(spark, sf_dir))


@query(FACTS_SQL + """, c AS (SELECT entity, dimension, value, valid_from, id, lag(value) OVER (PARTITION BY entity, dimension ORDER BY written_at, value) AS b, written_at FROM f),
s AS (SELECT * FROM c WHERE b IS NULL OR b <> value) SELECT entity, dimension, value, written_at AS valid_from, lead(written_at) OVER (PARTITION BY entity, dimension ORDER BY written_at, value) AS valid_until FROM s""")
def ontology_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validity intervals of changing values (slowly changing dimension)."""
    f = facts(spark, sf_dir).select("entity", "dimension", "value", F.col("written_at").cast("timestamp_ntz").alias("written_at"))
    return K.scd2(f, ["entity", "dimension"], "value", "written_at").select("entity", "dimension", "value", "valid_from", "valid_until")


@query(FACTS_SQL + "SELECT dimension, count(DISTINCT entity) AS entities, count(*) AS n FROM f GROUP BY 1")
def ontology_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities and facts of each dimension."""
    return facts(spark, sf_dir).groupBy("dimension").agg(F.countDistinct("entity").alias("entities"), F.count("*").alias("n"))


@query(FACTS_SQL + "SELECT id, source_id FROM f WHERE source_id IN ('s0', 's2')")
def scoped_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of two tenants; an empty scope adds nothing."""
    f = facts(spark, sf_dir)
    return K.in_scope(f, ["s0", "s2"]).unionAll(K.in_scope(f, [])).select("id", "source_id")


@query("""WITH p(entity, dimension, new_value, new_from) AS (VALUES ('a','role','cto',DATE '2024-02-01'), ('b','role','ceo',DATE '2023-01-01'), ('c','role','ceo',DATE '2024-03-01'), ('d','role','dev',DATE '2024-01-01'), ('e','role','x',DATE '2020-01-01'))
SELECT entity, dimension, action, value, CAST(valid_from AS DATE) AS valid_from, confidence::DOUBLE AS confidence, CAST(closes_old_at AS DATE) AS closes_old_at FROM (VALUES
 ('a','role','supersede','cto','2024-02-01',0.7,'2024-02-01'), ('b','role','backdate','ceo','2023-01-01',0.85,NULL), ('c','role','corroborate','ceo','2024-01-01',1.0,NULL), ('d','role','insert','dev','2024-01-01',0.7,NULL), ('e','role','noop','y','2024-01-01',0.6,NULL)
) t(entity, dimension, action, value, valid_from, confidence, closes_old_at)""")
def ontology_propose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merging proposals into current values."""
    d = lambda s: F.to_date(F.lit(s))
    current = spark.createDataFrame([("a", "role", "ceo", 0.7), ("b", "role", "ceo", 0.8), ("c", "role", "ceo", 0.98), ("e", "role", "y", 0.6)], "entity string, dimension string, value string, confidence double").withColumn("valid_from", d("2024-01-01"))
    new = spark.createDataFrame([("a", "role", "cto", "2024-02-01"), ("b", "role", "ceo", "2023-01-01"), ("c", "role", "ceo", "2024-03-01"), ("d", "role", "dev", "2024-01-01"), ("e", "role", "x", "2020-01-01")], "entity string, dimension string, value string, v string")
    return K.propose(current, new.withColumn("valid_from", F.to_date("v"))).withColumn("confidence", F.round("confidence", 6))


@query("""WITH a AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 2 = 0), b AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 2 = 1),
m AS (SELECT a.id, CAST(a.label AS VARCHAR) AS entity_slug, max(list_cosine_similarity(a.v, b.v)) AS s FROM a LEFT JOIN b USING (label) GROUP BY 1, 2)
SELECT id, entity_slug, round(s, 5) AS similarity, CASE WHEN s >= 0.95 THEN 'duplicate' WHEN s >= 0.92 THEN 'likely' ELSE 'new' END AS verdict FROM m""")
def fact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest stored fact of the same entity."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("entity_slug"), "embedding")
    return K.duplicates(v.where("id % 2 = 0"), v.where("id % 2 = 1")).select("id", "entity_slug", F.round("similarity", 5).alias("similarity"), "verdict")


@query()
def fact_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leader clusters of vectors within a label, and what they promote."""
    v = table(spark, sf_dir, "embeddings").select(F.lit("s").alias("source_id"), F.col("label").cast("string").alias("entity_slug"), F.col("vec_id").alias("id"), "embedding", ((F.col("vec_id") % 10) / 10.0).alias("confidence"))
    return K.promote(K.leader_clusters(v, 0.2), v)


@query("""WITH f(entity, fact) AS (VALUES ('a','Likes  Tea'), ('a','new fact'), ('b','gone')), s(entity, fact, gone) AS (VALUES ('a','likes tea',false), ('a','old fact',false), ('b','GONE',true)),
fk AS (SELECT DISTINCT entity, md5(lower(trim(regexp_replace(fact,'\\s+',' ','g')))) AS key FROM f), sk AS (SELECT entity, md5(lower(trim(regexp_replace(fact,'\\s+',' ','g')))) AS key, bool_or(gone) AS gone FROM s GROUP BY 1, 2)
SELECT coalesce(fk.entity, sk.entity) AS entity_slug, coalesce(fk.key, sk.key) AS key, CASE WHEN sk.gone IS NULL THEN 'add' WHEN sk.gone THEN 'withdrawn' WHEN fk.key IS NOT NULL THEN 'keep' ELSE 'forget' END AS action FROM fk FULL JOIN sk ON fk.entity = sk.entity AND fk.key = sk.key""")
def fact_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full outer join of stated and stored facts."""
    f = spark.createDataFrame([("a", "Likes  Tea"), ("a", "new fact"), ("b", "gone")], "entity_slug string, fact string")
    s = spark.createDataFrame([("a", "likes tea", False), ("a", "old fact", False), ("b", "GONE", True)], "entity_slug string, fact string, gone boolean")
    return K.reconcile(f, s.withColumn("forgotten_at", F.when(F.col("gone"), now())))


def at_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").withColumnRenamed("o_orderdate", "occurred_at")


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) = d AS on_day, date_trunc('week', o_orderdate) = date_trunc('week', d) AS in_week, month(o_orderdate) = month(d) AND day(o_orderdate) = day(d) AND year(o_orderdate) < year(d) AS this_day
FROM orders, (SELECT max(CAST(o_orderdate AS DATE)) AS d FROM orders) WHERE CAST(o_orderdate AS DATE) = d OR date_trunc('week', o_orderdate) = date_trunc('week', d) OR (month(o_orderdate) = month(d) AND day(o_orderdate) = day(d))""")
def chronicle_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a day, of its ISO week, and of the same day in earlier years."""
    o = at_orders(spark, sf_dir)
    last = F.lit(o.agg(F.max(F.to_date("occurred_at"))).first()[0])
    rows = [(L.on_day(o, last), 1), (L.in_week(o, last), 2), (L.on_this_day(o, last), 4)]
    flagged = [f.select("o_orderkey", F.lit(n).alias("f")) for f, n in rows]
    all_rows = flagged[0].unionAll(flagged[1]).unionAll(flagged[2]).groupBy("o_orderkey").agg(F.sum("f").alias("f"))
    bit = lambda n: F.col("f").bitwiseAND(n) > 0
    return all_rows.select("o_orderkey", bit(1).alias("on_day"), bit(2).alias("in_week"), bit(4).alias("this_day"))


@query("SELECT user_id, count(*) AS n, min(ts) AS first_at FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-20' GROUP BY 1")
def chronicle_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events since a day."""
    return L.since(table(spark, sf_dir, "events"), day(), "ts").groupBy("user_id").agg(F.count("*").alias("n"), F.min("ts").alias("first_at"))


@query("SELECT user_id AS entity, max(ts) AS last_at, CAST(greatest(date_diff('day', CAST(max(ts) AS DATE), DATE '2024-01-20'), 0) AS INTEGER) AS days_ago FROM events WHERE CAST(ts AS DATE) <= DATE '2024-01-20' GROUP BY 1")
def last_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest event of each entity up to a day."""
    return L.last_seen(table(spark, sf_dir, "events").withColumnsRenamed({"user_id": "entity", "ts": "occurred_at"}), day())


@query("""WITH l AS (SELECT event_id, user_id, event_type, ts, value, lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS before FROM events)
SELECT event_id, user_id, event_type, round((value - before) / before, 6) AS change FROM l WHERE before <> 0 AND (value - before) / before <= -0.1""")
def trajectory_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drops of a tenth or more from one point of a series to the next."""
    e = table(spark, sf_dir, "events")
    return L.regressions(e, ["user_id", "event_type"], "ts", "value", "event_id").select("event_id", "user_id", "event_type", F.round("change", 6).alias("change"))


@query("""WITH l AS (SELECT label, vec_id, embedding::DOUBLE[] AS v, lag(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings)
SELECT label, count(*) AS points, round(least(greatest(1 - avg(CASE WHEN b IS NOT NULL THEN list_cosine_similarity(v, b) END), 0), 1), 5) AS drift FROM l GROUP BY 1 HAVING count(*) >= 3""")
def drift_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One less the mean cosine of consecutive vectors."""
    return L.drift(table(spark, sf_dir, "embeddings"), ["label"], "vec_id").select("label", "points", F.round("drift", 5).alias("drift"))


@query("""SELECT 'u' || user_id AS entity, event_type AS metric, ts AS at, value, 'claim' AS origin FROM events UNION ALL SELECT 'o' || o_custkey, NULL, o_orderdate, NULL, 'event' FROM orders""")
def trajectory_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims and events as one series."""
    c = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), "user_id").alias("entity"), F.col("event_type").alias("metric"), F.col("ts").alias("at"), "value")
    return L.trajectory(c, table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), "o_custkey").alias("entity"), F.col("o_orderdate").alias("at")))


@query("""WITH t AS (SELECT conv_id, count(*) AS turns FROM conversations GROUP BY 1), m AS (SELECT conv_id, role AS entity, max(turn) AS last, count(*) AS n, max(CASE WHEN role = 'user' THEN 1 ELSE 0 END) AS u FROM conversations GROUP BY 1, 2)
SELECT conv_id, entity, round((last + 1) / turns + 0.1 * least(n, 4) + CASE WHEN u = 1 THEN 0.15 ELSE 0 END, 6)::DOUBLE AS salience FROM m JOIN t USING (conv_id)""")
def window_salience(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Salience of speakers within conversations."""
    c = table(spark, sf_dir, "conversations")
    return L.window_salience(c, c.withColumn("entity", F.col("role"))).withColumn("salience", F.round("salience", 6))


@query("""WITH t AS (SELECT doc_id, quality, toxic, (doc_id % 11) / 10.0 AS w, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN quality = 1 AND toxic = 1 THEN 'partial' WHEN quality = 1 THEN 'correct' ELSE 'incorrect' END AS verdict FROM labels)
SELECT coalesce(source, '(unclassified)') AS domain, count(*) AS takes, count(verdict) AS resolved, count(*) FILTER (verdict = 'correct') AS correct, count(*) FILTER (verdict = 'incorrect') AS incorrect, count(*) FILTER (verdict = 'partial') AS partial,
 round((count(*) FILTER (verdict = 'correct') + 0.5 * count(*) FILTER (verdict = 'partial')) / count(verdict), 6)::DOUBLE AS profile_accuracy,
 round(count(*) FILTER (verdict = 'correct') / (count(*) FILTER (verdict = 'correct') + count(*) FILTER (verdict = 'incorrect')), 6)::DOUBLE AS scorecard_accuracy,
 round(avg(CASE verdict WHEN 'correct' THEN pow(w - 1, 2) WHEN 'incorrect' THEN pow(w, 2) END), 6)::DOUBLE AS brier FROM t JOIN documents USING (doc_id) GROUP BY 1""")
def takes_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scorecard of graded takes by domain, with both definitions of accuracy."""
    t = Q.takes(table(spark, sf_dir, "labels")).join(table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("domain")), "doc_id")
    return Q.scorecard(t, "domain")


@query("""WITH t AS (SELECT (doc_id % 11) / 10.0 AS w, CASE WHEN doc_id % 5 = 0 OR (quality = 1 AND toxic = 1) THEN NULL ELSE quality END AS outcome FROM labels)
SELECT CAST(least(floor(w * 10), 9) AS INTEGER) AS bucket, count(*) AS n, round(avg(outcome), 6) AS observed, round(avg(w), 6)::DOUBLE AS predicted FROM t WHERE outcome IS NOT NULL GROUP BY 1""")
def calibration_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed and predicted rates by weight bucket."""
    return Q.calibration(Q.takes(table(spark, sf_dir, "labels")))


@query("""WITH b AS (SELECT source, count(*) AS n, sum(quality) AS k FROM labels JOIN documents USING (doc_id) GROUP BY 1), p AS (SELECT *, k / n AS p, 1.959963984540054 AS z FROM b)
SELECT source, n, CAST(k AS BIGINT) AS k, round(CASE WHEN k = 0 THEN 0.0 ELSE greatest(0, (p + z*z/(2*n) - z*sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n)) END, 6)::DOUBLE AS low,
 round(CASE WHEN k = n THEN 1.0 ELSE least(1, (p + z*z/(2*n) + z*sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n)) END, 6)::DOUBLE AS high, n < 30 AS small_sample FROM p""")
def wilson_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wilson intervals of quality by source."""
    b = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.sum("quality").alias("k"))
    low, high = M.wilson(F.col("k"), F.col("n"))
    return b.select("source", "n", "k", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"), (F.col("n") < 30).alias("small_sample"))


@query("""WITH v AS (SELECT o_custkey AS take, (['correct','incorrect','partial'])[o_orderkey % 3 + 1] AS verdict, o_orderkey % 10 AS conf FROM orders),
g AS (SELECT take, verdict, count(*) AS n, sum(conf) AS s, quantile_cont(conf, 0.5) AS med FROM v GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY take ORDER BY n DESC, s DESC, CASE verdict WHEN 'correct' THEN 1 WHEN 'incorrect' THEN 2 ELSE 3 END) AS k FROM g)
SELECT take, verdict, n AS votes, round(med / 10, 6)::DOUBLE AS confidence FROM r WHERE k = 1""")
def verdict_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Majority verdicts, ties by confidence and a fixed order, with the winners' median confidence."""
    verdict = F.element_at(F.array(F.lit("correct"), F.lit("incorrect"), F.lit("partial")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    v = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("take"), verdict.alias("verdict"), (F.col("o_orderkey") % 10).alias("c"))
    return Q.ensemble(v).select("take", "verdict", "votes", F.round(F.col("confidence") / 10, 6).alias("confidence"))


METRICS_SQL = """WITH r AS (SELECT o_custkey AS q, list(o_orderkey ORDER BY o_totalprice DESC, o_orderkey) AS ranked, list(DISTINCT o_orderkey) FILTER (o_orderpriority IN ('1-URGENT','2-HIGH')) AS rel0 FROM orders GROUP BY 1),
x AS (SELECT q, ranked, coalesce(rel0, []) AS rel, list_slice(ranked, 1, 5) AS top FROM r), y AS (SELECT *, len(list_intersect(top, rel)) AS hit, list_transform(top, lambda t: CASE WHEN list_contains(rel, t) THEN 1.0 ELSE 0.0 END) AS g FROM x)
"""


def rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    ranked = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("o_totalprice")).alias("p"), "o_orderkey"))), lambda s: s["o_orderkey"])
    rel = F.collect_set(F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.col("o_orderkey")))
    return o.groupBy(F.col("o_custkey").alias("q")).agg(ranked.alias("ranked"), rel.alias("relevant"))


@query(METRICS_SQL + """SELECT q, hit / 5 AS precision, round(CASE WHEN len(rel) = 0 THEN 0.0 ELSE hit / len(rel) END, 6)::DOUBLE AS recall,
 round(coalesce(1 / (SELECT min(i) FROM (SELECT unnest(range(1, len(ranked) + 1)) AS i, unnest(ranked) AS v) WHERE list_contains(rel, v)), 0), 6)::DOUBLE AS rr,
 round(CASE WHEN len(rel) = 0 THEN 0.0 ELSE (SELECT sum(gg / log2(i + 1)) FROM (SELECT unnest(range(1, len(g) + 1)) AS i, unnest(g) AS gg)) / (SELECT sum(1 / log2(i + 1)) FROM range(1, greatest(least(len(rel), 5), 1) + 1) z(i)) END, 6)::DOUBLE AS ndcg FROM y""")
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall, reciprocal rank and nDCG at 5."""
    r, rel = F.col("ranked"), F.col("relevant")
    return rankings(spark, sf_dir).select("q", M.precision_at(r, rel, 5).alias("precision"), F.round(M.recall_at(r, rel, 5), 6).alias("recall"), F.round(M.reciprocal_rank(r, rel), 6).alias("rr"), F.round(M.ndcg_at(r, rel, 5), 6).alias("ndcg"))


@query("""WITH a AS (SELECT o_custkey AS q, list(o_orderkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders GROUP BY 1), b AS (SELECT o_custkey AS q, list(o_orderkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders GROUP BY 1),
x AS (SELECT q, list_slice(a.r, 1, 5) AS s, list_slice(b.r, 1, 5) AS t, a.r[1] = b.r[1] AS top1 FROM a JOIN b USING (q))
SELECT q, round(len(list_intersect(s, t)) / (len(s) + len(t) - len(list_intersect(s, t))), 6) AS jaccard, top1 AS top1_stable FROM x""")
def replay_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of two rankings of the same queries."""
    by_date = F.transform(F.array_sort(F.collect_list(F.struct((-F.unix_micros(F.col("o_orderdate").cast("timestamp"))).alias("p"), "o_orderkey"))), lambda s: s["o_orderkey"])
    b = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("q")).agg(by_date.alias("other"))
    return rankings(spark, sf_dir).join(b, "q").select("q", F.round(M.jaccard_at(F.col("ranked"), F.col("other"), 5), 6).alias("jaccard"), (F.col("ranked")[0] == F.col("other")[0]).alias("top1_stable"))


@query("SELECT CAST(ts AS DATE) AS day, event_type AS mode, json_extract_string(props, '$.k') AS intent, count(*) AS n, round(sum(value), 4) AS total, round(sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) / count(*), 6) AS hit_rate FROM events GROUP BY 1, 2, 3")
def telemetry_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counters by mode and intent."""
    return Q.daily_counters(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4)).withColumn("hit_rate", F.round("hit_rate", 6))


@query("""SELECT c_mktsegment AS operation, o_orderpriority AS model, grouping(c_mktsegment) + 0 AS all_operations, count(*) AS n, round(sum(o_totalprice), 2) AS spend, count(*) FILTER (o_totalprice < 1000) AS unpriced
FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY GROUPING SETS ((c_mktsegment, o_orderpriority), (c_mktsegment), (o_orderpriority), ())""")
def spend_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spend over grouping sets."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    return Q.spend(o, "c_mktsegment", "o_orderpriority", "o_totalprice", 1000)


@query("""SELECT md5(text) AS content_hash, count(*) AS n, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS ids, count(*) OVER () AS groups FROM documents GROUP BY md5(text) HAVING count(*) > 1""")
def duplicate_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with equal content, their ids in order, and the number of such groups."""
    return Q.duplicate_groups(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("""SELECT coalesce(source, '(unclassified)') AS source, count(DISTINCT doc_id) AS docs, count(DISTINCT doc_id) FILTER (quality IS NOT NULL) AS labelled,
 round(count(DISTINCT doc_id) FILTER (quality IS NOT NULL) / count(DISTINCT doc_id), 6) AS coverage FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def source_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of sources by conditional distinct counts."""
    return Q.source_health(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumn("coverage", F.round("coverage", 6))


@query("""WITH c AS (SELECT unnest(list_distinct(string_split(p_type, ' '))) AS concept FROM part) SELECT concept, count(*) AS atoms, CASE WHEN count(*) >= 1000 THEN 'T1' WHEN count(*) >= 400 THEN 'T2' WHEN count(*) >= 100 THEN 'T3' END AS tier FROM c GROUP BY 1""")
def concept_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts by number of atoms, with tiers (limits scaled to this table)."""
    return Q.concepts(table(spark, sf_dir, "part").select(F.split("p_type", " ").alias("concepts")), (1000, 400, 100))


@query("""WITH v AS (SELECT o_custkey AS slug, o_orderkey AS version_n, md5(o_orderstatus) AS h, o_orderdate AS at, o_totalprice FROM orders),
l AS (SELECT *, lag(h) OVER (PARTITION BY slug ORDER BY version_n) AS before FROM v), k AS (SELECT * FROM l WHERE before IS NULL OR before <> h),
n AS (SELECT slug, row_number() OVER (PARTITION BY slug ORDER BY version_n) AS n, row_number() OVER (PARTITION BY slug ORDER BY version_n DESC) AS back, version_n FROM k)
SELECT slug, version_n, n FROM n WHERE back = 1""")
def page_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upserts that change content append a version; the latest is the page."""
    v = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("slug"), F.col("o_orderkey").alias("written"), F.col("o_orderstatus").alias("body"))
    return P.latest(P.version_log(v, "written")).select("slug", F.col("written").alias("version_n"), F.col("version_n").alias("n"))


@query("""SELECT coalesce(m.new, e.src) AS src, coalesce(m2.new, e.dst) AS dst FROM (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem) e LEFT JOIN (VALUES (1, 2), (3, 4)) m(old, new) ON m.old = e.src LEFT JOIN (VALUES (1, 2), (3, 4)) m2(old, new) ON m2.old = e.dst GROUP BY 1, 2""")
def rename_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Renamed pages in links, with collisions folded."""
    e = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()
    return P.renamed(e, spark.createDataFrame([(1, 2), (3, 4)], "old long, new long"), ["src", "dst"])


@query("""WITH s AS (SELECT c_mktsegment AS m, count(*) AS n FROM customer GROUP BY 1) SELECT m, n, CAST(5 * pow(2, least(n % 12, 30)) AS DOUBLE) AS b, least(5 * pow(2, least(n % 12, 30)), 1800)::DOUBLE AS backoff FROM s""")
def retry_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exponential backoff with a ceiling."""
    s = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("m")).agg(F.count("*").alias("n"))
    return s.select("m", "n", (5.0 * F.pow(F.lit(2.0), F.least(F.col("n") % 12, F.lit(30)))).alias("b"), M.backoff_seconds(F.col("n") % 12).alias("backoff"))


@query("""SELECT n_name, round(least(greatest(CASE WHEN n_nationkey % 2 = 0 THEN 0.5 ELSE 0 END + least(ln(1 + d) / ln(21), 1) * 0.5 + least(0.05 * (d % 5), 0.15) + 0.05 * 0.4, 0), 1), 6)::DOUBLE AS salience
FROM (SELECT n_nationkey, n_name, count(s_suppkey) AS d FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2)""")
def page_salience(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Salience from tag, degree and takes."""
    s = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("d"))
    n = table(spark, sf_dir, "nation").join(s, "n_nationkey", "left").withColumn("d", F.coalesce("d", F.lit(0)))
    return n.select("n_name", F.round(R.salience_score(F.col("n_nationkey") % 2 == 0, F.col("d"), F.col("d") % 5, F.lit(0.4)), 6).alias("salience"))


@query("SELECT (SELECT count(*) FROM orders) AS rows_a, (SELECT count(*) FROM orders) AS rows_b, true AS equal")
def table_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-insensitive comparison of two copies of a table."""
    o = table(spark, sf_dir, "orders")
    return Q.same_content(o, o.orderBy(F.desc("o_totalprice")))


@query("SELECT event_type AS kind, count(*) AS n, max(ts) AS latest FROM events WHERE ts > TIMESTAMP '2024-01-29' AND ts <= TIMESTAMP '2024-01-30' GROUP BY 1")
def friction_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by kind in the last day."""
    return Q.recent_by_kind(table(spark, sf_dir, "events"), F.lit("2024-01-30").cast("timestamp_ntz"), 24)


@query("""WITH s AS (SELECT CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY 1), t AS (SELECT d, sum(n) OVER (ORDER BY d ROWS UNBOUNDED PRECEDING) AS total FROM s)
SELECT CAST((SELECT total FROM t ORDER BY d DESC LIMIT 1) - (SELECT total FROM t WHERE d <= (SELECT max(d) FROM t) - 7 ORDER BY d DESC LIMIT 1) AS BIGINT) AS delta""")
def snapshot_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest snapshot less the last one a week older."""
    s = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return Q.snapshot_delta(s, 7)
