"""Health, usage, spend and calibration reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.stats import brier


def takes(labels: DataFrame) -> DataFrame:
    """Labels as takes with a weight and a verdict: every fifth is ungraded."""
    verdict = F.when(F.col("doc_id") % 5 == 0, None).when((F.col("quality") == 1) & (F.col("toxic") == 1), "partial").when(F.col("quality") == 1, "correct").otherwise("incorrect")
    return labels.select("doc_id", ((F.col("doc_id") % 11) / 10.0).alias("weight"), verdict.alias("verdict"))


def outcome(verdict: Column) -> Column:
    return F.when(verdict == "correct", 1.0).when(verdict == "incorrect", 0.0)


def scorecard(graded: DataFrame, by: str) -> DataFrame:
    """Counts, Brier score and both accuracies: partial as half over resolved, and correct over decided."""
    n = lambda v: F.count_if(F.col("verdict") == v)
    resolved, decided = F.count("verdict"), n("correct") + n("incorrect")
    return graded.groupBy(F.coalesce(F.nullif(F.trim(by), F.lit("")), F.lit("(unclassified)")).alias(by)).agg(
        F.count("*").alias("takes"), resolved.alias("resolved"), n("correct").alias("correct"), n("incorrect").alias("incorrect"), n("partial").alias("partial"),
        F.round((n("correct") + 0.5 * n("partial")) / F.nullif(resolved, F.lit(0)), 6).alias("profile_accuracy"),
        F.round(n("correct") / F.nullif(decided, F.lit(0)), 6).alias("scorecard_accuracy"), F.round(brier(F.col("weight"), outcome(F.col("verdict"))), 6).alias("brier"),
    )


def calibration(graded: DataFrame, buckets: int = 10) -> DataFrame:
    """(bucket, n, observed, predicted) of decided takes."""
    decided = graded.withColumn("outcome", outcome(F.col("verdict"))).where(F.col("outcome").isNotNull())
    # the weight as a decimal, so that 0.3 * 10 is in bucket 3
    bucket = F.least(F.floor(F.col("weight").cast("decimal(10,6)") * buckets), F.lit(buckets - 1)).cast("int")
    return decided.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg("outcome"), 6).alias("observed"), F.round(F.avg("weight"), 6).alias("predicted"))


def ensemble(votes: DataFrame) -> DataFrame:
    """(take, verdict, votes, confidence): majority, ties by summed confidence, then correct, incorrect, partial. ``votes``: take, verdict, c."""
    by = votes.groupBy("take", "verdict").agg(F.count("*").alias("votes"), F.sum("c").alias("_s"), F.expr("percentile(c, 0.5)").alias("confidence"))
    order = Window.partitionBy("take").orderBy(F.desc("votes"), F.desc("_s"), F.when(F.col("verdict") == "correct", 1).when(F.col("verdict") == "incorrect", 2).otherwise(3))
    return by.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_s")


def daily_counters(events: DataFrame) -> DataFrame:
    """(day, mode, intent, n, total, hit_rate) of search events."""
    return events.groupBy(F.to_date("ts").alias("day"), F.col("event_type").alias("mode"), F.get_json_object("props", "$.k").alias("intent")).agg(
        F.count("*").alias("n"), F.sum("value").alias("total"), (F.count_if(F.col("value") > 50) / F.count("*")).alias("hit_rate")
    )


def spend(rows: DataFrame, operation: str, model: str, amount: str, unpriced_below: float) -> DataFrame:
    """Spend by operation and model, by each alone, and in all."""
    sets = rows.groupingSets([[operation, model], [operation], [model], []], operation, model)
    return sets.agg(F.grouping(operation).cast("int").alias("all_operations"), F.count("*").alias("n"), F.round(F.sum(amount), 2).alias("spend"), F.count_if(F.col(amount) < unpriced_below).alias("unpriced")).withColumnsRenamed({operation: "operation", model: "model"})


def duplicate_groups(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(content_hash, n, ids, groups): documents with equal text."""
    groups = docs.groupBy(F.md5(text_col).alias("content_hash")).agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list(id_col)), ",").alias("ids")).where("n > 1")
    total = groups.agg(F.count("*").alias("groups"))
    return groups.crossJoin(F.broadcast(total))  # one row


def source_health(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(source, docs, labelled, coverage)."""
    joined = docs.select("doc_id", "source").join(labels.select("doc_id", "quality"), "doc_id", "left")
    labelled = F.countDistinct(F.when(F.col("quality").isNotNull(), F.col("doc_id")))
    return joined.groupBy(F.coalesce("source", F.lit("(unclassified)")).alias("source")).agg(F.countDistinct("doc_id").alias("docs"), labelled.alias("labelled")).withColumn("coverage", F.col("labelled") / F.col("docs"))


def concepts(atoms: DataFrame, tiers: tuple[int, int, int] = (10, 5, 2)) -> DataFrame:
    """(concept, atoms, tier) of rows with an array of concepts."""
    n = F.col("atoms")
    tier = F.when(n >= tiers[0], "T1").when(n >= tiers[1], "T2").when(n >= tiers[2], "T3")
    return atoms.select(F.explode(F.array_distinct("concepts")).alias("concept")).groupBy("concept").agg(F.count("*").alias("atoms")).withColumn("tier", tier)


def same_content(a: DataFrame, b: DataFrame) -> DataFrame:
    """(rows_a, rows_b, equal): counts and order-insensitive sums of row hashes agree."""
    digest = lambda df: df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(20,0)")).alias("h"))
    return digest(a).alias("a").crossJoin(digest(b).alias("b")).select(F.col("a.n").alias("rows_a"), F.col("b.n").alias("rows_b"), (F.col("a.h").eqNullSafe(F.col("b.h")) & (F.col("a.n") == F.col("b.n"))).alias("equal"))


def recent_by_kind(events: DataFrame, now: Column, hours: int, at: str = "ts", kind: str = "event_type") -> DataFrame:
    """(kind, n, latest) of the last hours."""
    return events.where((F.col(at) > now - F.expr(f"INTERVAL {hours} HOURS")) & (F.col(at) <= now)).groupBy(F.col(kind).alias("kind")).agg(F.count("*").alias("n"), F.max(at).alias("latest"))


def snapshot_delta(days: DataFrame, back: int) -> DataFrame:
    """Rows that the daily counts (day, n) gained in the ``back`` days before the last one."""
    last = days.agg(F.max("day").alias("_last"))
    return days.crossJoin(F.broadcast(last)).agg(F.sum(F.when(F.col("day") > F.date_sub("_last", back), F.col("n"))).alias("delta"))
