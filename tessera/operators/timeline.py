"""Timelines and series: windows by day and week, last seen, trajectories, regressions, drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.vector import cosine


def on_day(events: DataFrame, day: Column, at: str = "occurred_at") -> DataFrame:
    return events.where(F.to_date(at) == day)


def in_week(events: DataFrame, day: Column, at: str = "occurred_at") -> DataFrame:
    """Events of the ISO week of ``day``."""
    return events.where(F.date_trunc("week", at) == F.date_trunc("week", day))


def since(events: DataFrame, day: Column, at: str = "occurred_at") -> DataFrame:
    return events.where(F.to_date(at) >= day)


def on_this_day(events: DataFrame, day: Column, at: str = "occurred_at") -> DataFrame:
    """Events of the same month and day in earlier years."""
    return events.where((F.month(at) == F.month(day)) & (F.dayofmonth(at) == F.dayofmonth(day)) & (F.year(at) < F.year(day)))


def last_seen(events: DataFrame, day: Column, entity: str = "entity", at: str = "occurred_at") -> DataFrame:
    """(entity, last_at, days_ago): the latest event of each entity not after ``day``."""
    last = events.where(F.to_date(at) <= day).groupBy(entity).agg(F.max(at).alias("last_at"))
    return last.withColumn("days_ago", F.greatest(F.datediff(day, F.to_date("last_at")), F.lit(0)))


def add_events(timeline: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Timeline with the new events whose key it lacks."""
    fresh = new.dropDuplicates(key).join(timeline.select(*key), key, "left_anti")
    return timeline.unionByName(fresh, allowMissingColumns=True)


def trajectory(claims: DataFrame, events: DataFrame) -> DataFrame:
    """Metric claims and point events of entities as one series (entity, metric, at, value, origin)."""
    return claims.select("entity", "metric", "at", "value", F.lit("claim").alias("origin")).unionByName(events.select("entity", F.lit(None).cast("string").alias("metric"), "at", F.lit(None).cast("double").alias("value"), F.lit("event").alias("origin")))


def regressions(points: DataFrame, keys: list[str], at: str = "at", value: str = "value", id_col: str = "id", drop: float = 0.1) -> DataFrame:
    """Points that lie at least ``drop`` below the one before them in their series; a series value of 0 is no base."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(at, id_col))
    change = (F.col(value) - F.col("before")) / F.col("before")
    return points.withColumn("before", before).where("before <> 0").withColumn("change", change).where(F.col("change") <= -drop)


def drift(points: DataFrame, keys: list[str], order: str, vector: str = "embedding", least: int = 3) -> DataFrame:
    """One less the mean cosine of consecutive vectors, 0 to 1, for series of at least ``least`` points."""
    before = F.lag(vector).over(Window.partitionBy(*keys).orderBy(order))
    steps = points.withColumn("_before", before).withColumn("_c", F.when(F.col("_before").isNotNull(), cosine(F.col(vector), F.col("_before"))))
    return steps.groupBy(*keys).agg(F.count("*").alias("points"), F.avg("_c").alias("_m")).where(F.col("points") >= least).select(*keys, "points", F.least(F.greatest(1 - F.col("_m"), F.lit(0.0)), F.lit(1.0)).alias("drift"))


def effective_date(fields: list[Column], path: Column) -> Column:
    """The first frontmatter field that is a date, else a date in the file name, else null."""
    name = F.element_at(F.split(path, "/"), -1)
    in_name = F.concat_ws("-", *[F.nullif(F.regexp_extract(name, r"(\d{4})[-_]?(\d{2})[-_]?(\d{2})", i), F.lit("")) for i in (1, 2, 3)])
    return F.coalesce(*[F.try_to_date(F.substring(f, 1, 10)) for f in fields], F.when(F.length(in_name) == 10, F.try_to_date(in_name)))


def window_salience(turns: DataFrame, mentions: DataFrame) -> DataFrame:
    """(conv_id, entity, salience): recency and frequency of mentions (conv_id, turn, entity, role) within a conversation."""
    n = turns.groupBy("conv_id").agg(F.count("*").alias("turns"))
    seen = mentions.groupBy("conv_id", "entity").agg(F.max("turn").alias("last"), F.count("*").alias("n"), F.max((F.col("role") == "user").cast("int")).alias("by_user"))
    score = (F.col("last") + 1) / F.col("turns") + 0.1 * F.least(F.col("n"), F.lit(4)) + F.when(F.col("by_user") == 1, 0.15).otherwise(0.0)
    return seen.join(n, "conv_id").select("conv_id", "entity", score.alias("salience"))
