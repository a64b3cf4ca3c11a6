"""Connectors, stores, purges, sweeps and exports over files that are written from whole test tables, with the SQL that says what must be there."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.plans.registry import query, table
from tessera.plans.source_queries import shared_folder
from tessera.sources import connectors as CN
from tessera.sources import exports as EX
from tessera.sources import sweep as SW
from tessera.sources.store import Store
from tessera.streaming import ledger as LG
from tessera.streaming import streams as W

PAGES = 6


def event_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as versions of issues, on pages in no order of time."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.pmod(F.col("event_id"), F.lit(PAGES)).alias("page"), F.pmod(F.col("event_id"), F.lit(700)).alias("number"), F.col("event_type").alias("title"), F.col("props").alias("body"),
        F.when(F.col("value") < 50, "open").otherwise("closed").alias("state"), F.col("user_id").cast("string").alias("labels"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("updated_at"), "event_id",
    )


@query("""WITH i AS (SELECT event_id, event_type, value, user_id, props, ts, event_id % 6 AS page, row_number() OVER (PARTITION BY event_id % 700, event_id % 6 < 3 ORDER BY ts DESC, event_id % 6 DESC) AS n FROM events),
j AS (SELECT *, row_number() OVER (PARTITION BY number ORDER BY ts DESC) AS m FROM (SELECT *, event_id % 700 AS number FROM i WHERE n = 1 AND event_type <> 'error')),
k AS (SELECT *, 'github/acme/core/' || number AS slug, '# ' || event_type || chr(10) || chr(10) || 'State: ' || (CASE WHEN value < 50 THEN 'open' ELSE 'closed' END) || chr(10) || 'Labels: ' || user_id || chr(10) || chr(10) || props AS body FROM j WHERE m = 1)
SELECT slug, number, ts AS updated_at, sha256(slug || chr(10) || body) AS content_hash, (SELECT max(ts) FROM events) AS watermark FROM k""")
def connector_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items written out in pages and synced in three runs, the first over half of the pages, the last over all of them again without its state; an item whose last copy in
    a run is an error is refused and keeps the page it had."""
    folder = shared_folder(spark)
    items, store = event_items(spark, sf_dir).drop("event_id"), CN.page_store(spark, f"{folder}/store")
    refuse = F.col("title") == "error"
    for run, pages in enumerate(("page < 3", "page >= 3", None)):
        if pages:
            items.where(pages).write.mode("append").partitionBy("page").json(f"{folder}/pages")
        done = CN.sync(store, f"{folder}/pages", "github", "acme/core", f"{folder}/state{run // 2}", refuse)
    mark = F.lit(done.facts["watermark:github"]).cast("timestamp_ntz") if done.facts else F.lit(None).cast("timestamp_ntz")
    return store.rows().select("slug", "number", F.col("updated_at").cast("timestamp_ntz").alias("updated_at"), "content_hash", mark.alias("watermark"))


@query("SELECT event_id % 700 AS number, count(*) AS n, max(ts) AS last_at FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 3 DAYS GROUP BY 1")
def connector_pages_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items read by the data source from a watermark less a gap on."""
    folder = shared_folder(spark)
    items = event_items(spark, sf_dir).drop("event_id").persist()
    items.write.partitionBy("page").json(f"{folder}/pages")
    mark = items.agg(F.max("updated_at")).first()[0]
    spark.dataSource.register(CN.PagedItems)
    read = spark.read.format("paged_items").option("since", CN.since_for(mark, 3 * 24 * 60)).load(f"{folder}/pages")
    return read.groupBy("number").agg(F.count("*").alias("n"), F.max("updated_at").cast("timestamp_ntz").alias("last_at"))


@query("""WITH e AS (SELECT event_type AS connector, 'item' || (event_id % 900) AS slug, event_id % 4 = 0 AS settled, 'c' || (event_id % 3) AS code, ts AS "at", row_number() OVER (PARTITION BY event_type, event_id % 900 ORDER BY ts DESC, event_id % 4 = 0 DESC) AS n FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY connector ORDER BY "at" DESC, slug DESC) AS recent, count(*) OVER (PARTITION BY connector) AS held FROM e WHERE n = 1 AND NOT settled)
SELECT connector, slug, code, "at", CAST(least(held, 200) - recent + 1 AS INTEGER) AS place FROM r WHERE recent <= 200""")
def stream_refused_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of refused items of each connector after a stream of refusals and settlements: the latest 200 that are not settled."""
    e = W.table_stream(spark, sf_dir, "events")
    k = F.col("event_id")
    events = e.select(F.col("event_type").alias("connector"), F.concat(F.lit("item"), k % 900).alias("slug"), F.concat(F.lit("c"), k % 3).alias("code"), F.lit("refused").alias("reason"), F.col("ts").alias("at"), (k % 4 == 0).alias("settled"))
    with LG.keyed_state(spark):
        out = W.drained(LG.refused_items(events), shared_folder(spark), "update")
    last = Window.partitionBy("connector").orderBy(F.desc("version"))
    now = out.withColumn("_n", F.rank().over(last)).where("_n = 1 AND place > 0")
    return now.select("connector", "slug", "code", F.col("at").cast("timestamp_ntz").alias("at"), "place")


def event_store(spark: SparkSession, folder: str) -> Store:
    """Events by day."""
    return Store(spark, folder, "event_id long, ts timestamp, event_type string", F.to_date("ts"))


@query("""WITH e AS (SELECT event_id, ts, CAST(ts AS DATE) AS day FROM events), c AS (SELECT max(ts) - INTERVAL '10 days 6 hours' AS cut FROM events)
SELECT day, count(*) AS n, min(ts) AS first_at, day > CAST(cut AS DATE) AS untouched FROM e, c WHERE ts >= cut GROUP BY day, cut""")
def purge_by_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events stored by day and purged by age: expired days are dropped unread, the day of the cut is written anew, younger days keep their files."""
    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    store = event_store(spark, shared_folder(spark))
    before = store.change("load", 0, lambda base: ([str(r[0]) for r in events.select(F.to_date("ts")).distinct().collect()], events, {}))
    cut = events.agg(F.expr("max(ts) - interval 10 days 6 hours")).first()[0]
    day = str(cut.date())
    after = store.purge(F.col("ts") < F.lit(cut), lambda p: None if p == day else p < day, "purge", 0)
    kept = spark.createDataFrame([(p, before.parts.get(p) == f) for p, f in after.parts.items()], "day string, untouched boolean")  # a row a day
    rows = store.rows().groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.min("ts").cast("timestamp_ntz").alias("first_at"))
    return rows.join(F.broadcast(kept.withColumn("day", F.col("day").cast("date"))), "day")


@query("""SELECT generation, count(*) AS n, round(sum(price), 2) AS total FROM (
SELECT 1 AS generation, o_totalprice AS price FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL
SELECT 2, CASE WHEN o_orderkey % 5 = 0 THEN 2 * o_totalprice ELSE o_totalprice END FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 5 = 0 UNION ALL
SELECT 3, CASE WHEN o_orderkey % 5 = 0 THEN 2 * o_totalprice ELSE o_totalprice END FROM orders WHERE (o_orderkey % 3 <> 0 OR o_orderkey % 5 = 0) AND o_orderstatus <> 'F') GROUP BY 1""")
def store_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store read as of each of its generations: a load, an upsert that is run twice, and a purge of what is finished."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"), F.lit(1).alias("version"))
    store = Store(spark, shared_folder(spark), "id long, price double, status string, version int", F.pmod(F.xxhash64("id"), F.lit(8)))
    store.upsert(o.where("id % 3 <> 0"), ["id"], "version", "load", 0)
    for _ in range(2):
        store.upsert(o.where("id % 5 = 0").withColumns({"price": 2 * F.col("price"), "version": F.lit(2)}), ["id"], "version", "load", 1)
    store.purge(F.col("status") == "F", lambda part: None, "purge", 0)
    parts = [store.rows(as_of=g).agg(F.lit(g).alias("generation"), F.count("*").alias("n"), F.round(F.sum("price"), 2).alias("total")) for g in (1, 2, 3)]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@query(r"""WITH d AS (SELECT *, doc_id // 25 AS folder FROM documents), f AS (SELECT folder, string_agg(coalesce(text, ''), chr(10) ORDER BY doc_id) || chr(10) AS text FROM d GROUP BY 1)
SELECT folder, CASE WHEN folder % 10 = 7 OR folder % 4 = 0 THEN 2 ELSE 1 END AS sweep, md5(CASE WHEN folder % 10 <> 7 AND folder % 4 = 0 THEN text || 'changed ' || folder || chr(10) ELSE text END) AS hash FROM f WHERE folder % 10 <> 3""")
def incremental_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files written from all documents and swept; then some change, some go and some come, and they are swept twice more. ``sweep`` tells when a file was read."""
    folder = shared_folder(spark)
    root, store = f"{folder}/files", SW.file_store(spark, f"{folder}/store")
    number = F.floor(F.col("doc_id") / 25)
    rows = table(spark, sf_dir, "documents").select(number.alias("folder"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    put_files(rows.where("folder % 10 <> 7"), root)
    SW.sweep(store, root, 1, FILES)
    put_files(rows.where("folder % 10 = 7"), root)
    changed = rows.where("folder % 4 = 0 AND folder % 10 NOT IN (3, 7)")
    put_files(changed.unionByName(changed.groupBy("folder").agg(F.max("doc_id").alias("doc_id")).withColumn("text", F.concat(F.lit("changed "), "folder"))), root)
    drop_files(spark, root, lambda n: n % 10 == 3)
    SW.sweep(store, root, 2, FILES)
    SW.sweep(store, root, 3, FILES)
    return store.rows().select(F.regexp_extract("path", r"folder=(\d+)", 1).cast("long").alias("folder"), "sweep", F.md5("text").alias("hash"))


def put_files(rows: DataFrame, root: str) -> None:
    """One file a folder, with the texts of its rows in order; one that is there is replaced. Tasks write the files, and the commit moves whole folders."""
    placed = rows.repartition("folder").sortWithinPartitions("folder", "doc_id", F.col("text").startswith("changed ")).select("folder", "text")
    placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("folder").text(root)


#: The names of the files that ``put_files`` writes.
FILES = "part-*"


def drop_files(spark: SparkSession, root: str, which: Callable[[int], bool]) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    for f in files.listStatus(path(root)):
        if which(int(f.getPath().getName().split("=")[1])):
            files.delete(f.getPath(), True)


@query("""SELECT lang, count(*) AS n, sum(n_chars) AS n_chars, CAST(ceil(count(*) / 100.0) AS BIGINT) AS files, 0::BIGINT AS faults FROM documents GROUP BY lang""")
def corpus_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents exported as JSON by language in files of at most 100 rows with a manifest, read back and checked against it."""
    folder = shared_folder(spark)
    docs = table(spark, sf_dir, "documents")
    EX.export_rows(docs, folder, "json", ["lang"], 100)
    back = EX.read_back(spark, folder, docs.schema, "json")
    faults = EX.export_faults(spark, folder, docs.schema, "json").agg(F.count("*").alias("faults"))
    files = F.count_distinct(F.col("_metadata.file_path"))
    return back.groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"), files.alias("files")).crossJoin(F.broadcast(faults))


@query("SELECT (SELECT count(*) FROM documents) AS n_a, (SELECT count(*) FROM documents) AS n_b, true AS same")
def export_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as Parquet in bounded files and read back the same."""
    folder = shared_folder(spark)
    docs = table(spark, sf_dir, "documents")
    EX.export_rows(docs, folder, "parquet", rows_a_file=150)
    return EX.same_rows(docs, EX.read_back(spark, folder, docs.schema))
