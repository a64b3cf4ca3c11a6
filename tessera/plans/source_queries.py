"""Sources, chunking, evaluation and streaming over the test tables and small literal inputs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import chunking as C
from tessera.operators import evaluation as E
from tessera.plans.registry import query, table, texts
from tessera.operators.graph import with_checkpoint_dir
from tessera.sources import files as S
from tessera.sources import transcripts as H
from tessera.streaming import streams as W


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the cluster's checkpoint folder."""
    return f"{with_checkpoint_dir(spark)}/{uuid.uuid4().hex}"


@query()
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown chunks of all documents."""
    return C.chunked(texts(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "chunk_index", F.length("content").alias("n_chars"), F.md5("content").alias("hash"))


@query("""WITH c AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (trim(line) <> '') AS n_full, CAST(max(length(line)) AS INTEGER) AS longest FROM c GROUP BY 1""")
def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line statistics of documents."""
    c = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return c.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(F.trim("line") != "").alias("n_full"), F.max(F.length("line")).alias("longest"))


@query("""WITH i AS (SELECT o_custkey AS number, o_orderkey, o_orderdate AS updated_at, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders)
SELECT number, updated_at FROM i WHERE n = 1""")
def latest_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest copy of each item."""
    return H.latest_items(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("number"), F.col("o_orderdate").alias("updated_at")))


@query()
def conversation_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations in parts of at most 2000 bytes."""
    return H.packed_parts(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), "turn", "text"), 2000)


@query("""SELECT o_custkey AS k, o_orderkey % 2 = 0 AS fresh, max(o_totalprice) AS total FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1, 2
UNION ALL SELECT o_custkey, false, max(o_totalprice) FROM orders WHERE o_orderkey % 2 = 1 AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0) GROUP BY 1""")
def keyed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows replaced by key."""
    o = table(spark, sf_dir, "orders")
    side = lambda even: o.where(F.col("o_orderkey") % 2 == (0 if even else 1)).groupBy(F.col("o_custkey").alias("k")).agg(F.lit(even).alias("fresh"), F.max("o_totalprice").alias("total"))
    return S.upserted(side(False), side(True), ["k"])


@query()
def evaluation_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order rankings judged against urgent orders, compared with a ranking by date, with bootstrap intervals."""
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("id"), "o_totalprice", "o_orderdate", "o_orderpriority")
    ranked = lambda c: o.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(c), "id"))).select("query_id", "id", "rank")
    judged = o.where("o_orderpriority = '1-URGENT'").groupBy("query_id").agg(F.collect_set("id").alias("relevant"))
    now, before = E.run(ranked("o_totalprice"), judged, 5), E.run(ranked("o_orderdate"), judged, 5)
    return E.summary(now).crossJoin(E.compare(now, before).withColumnsRenamed({"passes": "holds", "queries": "paired"}))


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_daily_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling daily counters of a stream, in complete mode."""
    s = W.daily_counters(W.table_stream(spark, sf_dir, "events").withWatermark("ts", W.GAP), ["event_type"])
    return W.drained(s, shared_folder(spark), "complete").withColumn("total", F.round("total", 4))


@query("SELECT count(*) AS n, count(DISTINCT event_id) AS ids FROM events")
def stream_gap_heal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream read twice over, with repeats within the watermark dropped."""
    e = W.table_stream(spark, sf_dir, "events")
    out = W.drained(W.healed(e.withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2)))), ["event_id"]), shared_folder(spark))
    return out.agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("ids"))


@query("""WITH l AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS b FROM events),
s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM l)
SELECT user_id, min(ts) AS started_at, count(*) AS n FROM s GROUP BY user_id, g""")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions by a gap of six hours (the batch twin of the stream)."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return W.sessions(e, "user_id", gap="6 hours").select("user_id", F.col("started_at").cast("timestamp_ntz").alias("started_at"), "n")


@query()
def stream_token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate limiting of users by a stateful token bucket."""
    out = W.drained(W.token_bucket(W.table_stream(spark, sf_dir, "events"), "user_id", capacity=3, per_second=1e-5), shared_folder(spark))
    return out.groupBy("user_id").agg(F.count("*").alias("calls"), F.count_if("allowed").alias("allowed"))
