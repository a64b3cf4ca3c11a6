"""Pages as an append-only version log with tombstones, and the operations on it.

A log row is (slug, version_n, body, deleted, ...). Every operation returns new rows or a new view; nothing is updated in place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def version_log(writes: DataFrame, order: str) -> DataFrame:
    """Writes (slug, body, order column) as versions 1, 2, ...; a write that does not change the content is none."""
    w = Window.partitionBy("slug").orderBy(order)
    hashed = writes.withColumn("_h", F.md5("body"))
    changed = hashed.withColumn("_before", F.lag("_h").over(w)).where(F.col("_before").isNull() | ~F.col("_before").eqNullSafe(F.col("_h")))
    return changed.withColumn("version_n", F.row_number().over(w)).drop("_h", "_before")


def latest(log: DataFrame) -> DataFrame:
    """The last version of each page."""
    return log.withColumn("_n", F.row_number().over(Window.partitionBy("slug").orderBy(F.desc("version_n")))).where("_n = 1").drop("_n")


def live(log: DataFrame) -> DataFrame:
    return latest(log).where(~F.col("deleted"))


def put(log: DataFrame, writes: DataFrame) -> DataFrame:
    """New log rows for writes (slug, body, expected_version or null): changed content of pages at the expected version."""
    now = latest(log).select("slug", F.col("version_n").alias("_v"), F.md5("body").alias("_h"), F.col("deleted").alias("_gone"))
    met = writes.join(now, "slug", "left")
    wanted = F.col("expected_version").isNull() | (F.col("expected_version") == F.coalesce("_v", F.lit(0)))
    fresh = F.col("_h").isNull() | (F.md5("body") != F.col("_h")) | F.col("_gone")
    return met.where(wanted & fresh).select("slug", (F.coalesce("_v", F.lit(0)) + 1).alias("version_n"), "body", F.lit(False).alias("deleted"))


def append(log: DataFrame, additions: DataFrame) -> DataFrame:
    """Log rows that add text (slug, addition) to live pages."""
    now = live(log).select("slug", "body")
    bodies = additions.join(now, "slug", "left").select("slug", F.concat_ws("\n\n", "body", "addition").alias("body"), F.lit(None).cast("int").alias("expected_version"))
    return put(log, bodies)


def marked(log: DataFrame, slugs: DataFrame, deleted: bool) -> DataFrame:
    """Log rows that delete or restore pages."""
    now = latest(log).where(F.col("deleted") != F.lit(deleted))
    return now.join(slugs, "slug", "left_semi").select("slug", (F.col("version_n") + 1).alias("version_n"), "body", F.lit(deleted).alias("deleted"))


def revert(log: DataFrame, targets: DataFrame) -> DataFrame:
    """Log rows that bring back the body of an earlier version (slug, target_version)."""
    old = log.join(targets, "slug").where(F.col("version_n") == F.col("target_version")).select("slug", "body")
    now = latest(log).select("slug", F.col("version_n").alias("_v"))
    return old.join(now, "slug").select("slug", (F.col("_v") + 1).alias("version_n"), "body", F.lit(False).alias("deleted"))


def renamed(rows: DataFrame, mapping: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with renamed pages (old, new) in ``columns``; rows that become equal fold into one. Serves renames and merges."""

    def one(df: DataFrame, c: str) -> DataFrame:
        m = mapping.select(F.col("old").alias(c), F.col("new").alias("_new"))
        return df.join(m, c, "left").withColumn(c, F.coalesce("_new", c)).drop("_new")

    return reduce(one, columns, rows).select(*rows.columns).dropDuplicates()


def purged(log: DataFrame, now: Column, hours: int, at: str = "deleted_at") -> DataFrame:
    """The log without pages whose last row is a tombstone older than ``hours``."""
    old = latest(log).where(F.col("deleted") & (F.unix_timestamp(now) - F.unix_timestamp(at) > hours * 3600))
    return log.join(old.select("slug"), "slug", "left_anti")


def stale_mirrors(pages: DataFrame, mirrors: DataFrame, chunker_version: int, limit: int | None = None) -> DataFrame:
    """Pages whose search mirror is missing or differs in source, hash, title or chunker version, newest first."""
    m = mirrors.select(F.col("slug"), F.col("source_id").alias("_s"), F.col("content_hash").alias("_h"), F.col("title").alias("_t"), F.col("chunker_version").alias("_c"))
    fresh = F.col("source_id").eqNullSafe(F.col("_s")) & F.col("content_hash").eqNullSafe(F.col("_h")) & F.col("title").eqNullSafe(F.col("_t")) & (F.coalesce("_c", F.lit(-1)) >= chunker_version)
    stale = pages.join(m, "slug", "left").where(F.col("_h").isNull() | ~fresh).select(*pages.columns).orderBy(F.desc("updated_at"), "slug")
    return stale if limit is None else stale.limit(limit)
