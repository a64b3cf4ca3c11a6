"""Filters, audits and upkeep reads: dynamic filters, drift of ids, pending work, impact previews, usage."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import trigram_similarity

# fixed values: days that a unit of a relative date stands for
UNIT_DAYS = {"d": 1, "w": 7, "m": 30, "y": 365}


def date_boundary(value: str, which: str, now: dt.datetime) -> dt.datetime:
    """``7d``, ``2w``, ``6m`` or ``1y`` before now; a plain date as its start (since) or end (until); else an ISO time."""
    if m := re.fullmatch(r"(\d+)([dwmy])", value.strip()):
        return now - dt.timedelta(days=int(m[1]) * UNIT_DAYS[m[2]])
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}", value.strip()):
        day = dt.datetime.fromisoformat(value.strip())
        return day if which == "since" else day + dt.timedelta(days=1) - dt.timedelta(microseconds=1)
    return dt.datetime.fromisoformat(value)


def chunk_filters(chunks: DataFrame, languages: list[str] | None = None, kinds: list[str] | None = None, since: dt.datetime | None = None, until: dt.datetime | None = None) -> DataFrame:
    """Chunks by language, symbol kind and the document's effective (else updated) time; they push down to the scan."""
    at = F.coalesce("effective_date", "updated_at")
    for wanted, condition in ((languages, lambda: F.col("language").isin(languages)), (kinds, lambda: F.col("symbol_kind").isin(kinds)), (since, lambda: at >= F.lit(since)), (until, lambda: at <= F.lit(until))):
        if wanted is not None:
            chunks = chunks.where(condition())
    return chunks


def contains_text(col: Column, text: str) -> Column:
    """Case-insensitive containment; wildcards of the text are plain characters."""
    return F.contains(F.lower(col), F.lit(text.lower()))


def list_facts(facts: DataFrame, entity: str | None = None, kinds: list[str] | Column | None = None, text: str | None = None, least_confidence: float | None = None, include_forgotten: bool = False, limit: int | None = None) -> DataFrame:
    """Facts by optional conditions, newest first; ``kinds`` are names or a condition."""
    if not include_forgotten and "forgotten_at" in facts.columns:
        facts = facts.where("forgotten_at IS NULL")
    if entity is not None:
        facts = facts.where(F.col("entity") == entity)
    if isinstance(kinds, Column):
        facts = facts.where(kinds)
    elif kinds is not None:
        facts = facts.where(F.col("kind").isin(kinds)) if kinds else facts.where(F.lit(False))
    if text:
        facts = facts.where(contains_text(F.col("fact"), text))
    if least_confidence is not None:
        facts = facts.where(F.col("confidence") >= least_confidence)
    facts = facts.orderBy(F.desc("written_at"), F.desc("id"))
    return facts if limit is None else facts.limit(limit)


def structural_expansion(anchors: DataFrame, edges: DataFrame, chunks: DataFrame, hops: int = 2, cap: int = 50) -> DataFrame:
    """(id, score, hop): anchor chunks (id, score, symbol) and the chunks that call them or that they call, score 1/(1+hop) of the
    best anchor, the best ``cap`` new ones a hop. ``edges``: caller, callee, caller_chunk; ``chunks``: id, symbol, bare_symbol."""
    seen = anchors.select("id", "score", F.lit(0).alias("hop"))
    frontier = anchors.select("id", "symbol", "score")
    # a callee is named by its full or its bare symbol: two equi joins
    names = chunks.select(F.col("symbol").alias("callee"), F.col("id").alias("to"), F.col("symbol").alias("to_symbol")).unionAll(chunks.select("bare_symbol", "id", "symbol")).where("callee IS NOT NULL").distinct()
    for hop in range(1, hops + 1):
        callers = frontier.join(edges, F.col("symbol") == F.col("callee")).select(F.col("caller_chunk").alias("id"), F.col("caller").alias("symbol"), "score")
        callees = frontier.join(edges, F.col("symbol") == F.col("caller")).join(names, "callee").select(F.col("to").alias("id"), F.col("to_symbol").alias("symbol"), "score")
        met = callers.unionByName(callees).where("id IS NOT NULL").groupBy("id").agg(F.max("score").alias("score"), F.min("symbol").alias("symbol")).join(seen.select("id"), "id", "left_anti")
        frontier = met.orderBy(F.desc("score"), "id").limit(cap)
        seen = seen.unionByName(frontier.select("id", (F.col("score") / (1 + hop)).alias("score"), F.lit(hop).alias("hop")))
    return seen


def id_drift(docs: DataFrame, id_col: str, path_col: str) -> DataFrame:
    """Documents whose id is not the one their path gives."""
    return docs.where(F.col(id_col) != F.concat(F.lit("doc_"), F.substring(F.sha2(F.col(path_col), 256), 1, 16)))


def pages_to_scan(pages: DataFrame, done: DataFrame, running: DataFrame) -> DataFrame:
    """Pages neither done at their content hash and extractor version, nor in progress."""
    return pages.join(done, ["slug", "content_hash", "version"], "left_anti").join(running, "slug", "left_anti")


def delete_impact(docs: DataFrame, chunks: DataFrame, mentions: DataFrame, by: str) -> DataFrame:
    """What goes with a source: documents, chunks and mentions below it."""
    chain = docs.join(chunks, "document_id", "left").join(mentions, "chunk_id", "left")
    return chain.groupBy(by).agg(F.countDistinct("document_id").alias("documents"), F.countDistinct("chunk_id").alias("chunks"), F.countDistinct("mention_id").alias("mentions"))


def fuzzy_search(rows: DataFrame, text: str, col: str, least: float = 0.3) -> DataFrame:
    """Rows alike by trigrams, or that contain the text, most alike first."""
    s = trigram_similarity(F.col(col), F.lit(text))
    return rows.withColumn("similarity", s).where((F.col("similarity") >= least) | contains_text(F.col(col), text))


def top_with_samples(rows: DataFrame, key: Column, at: str, sample: str, k: int, samples: int = 3) -> DataFrame:
    """(key, n, samples): the k most frequent keys with their latest samples."""
    keyed = rows.select(key.alias("key"), at, sample).where("key IS NOT NULL")
    counts = keyed.groupBy("key").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "key").limit(k)
    w = Window.partitionBy("key").orderBy(F.desc(at), sample)
    latest = keyed.join(counts, "key").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= samples)
    return latest.groupBy("key", "n").agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", sample))), lambda x: x[sample]).alias("samples"))


def quiet(at: Column, start: int = 6, end: int = 8, zone: str = "Europe/Berlin") -> Column:
    """Whether a UTC time lies in quiet hours of a zone; hours may run over midnight."""
    hour = F.hour(F.from_utc_timestamp(at, zone))
    return (hour >= start) & (hour < end) if start <= end else (hour >= start) | (hour < end)


def calibration_profiles(grades: DataFrame, least: int = 5) -> DataFrame:
    """(source, graded, accuracy): the latest grade of each take, partial as half, for sources with ``least`` graded takes."""
    latest = grades.groupBy("take", "source").agg(F.max_by("verdict", "grade_id").alias("verdict"))
    right = F.count_if(F.col("verdict") == "correct") + 0.5 * F.count_if(F.col("verdict") == "partial")
    return latest.groupBy("source").agg(F.count("*").alias("graded"), (right / F.count("*")).alias("accuracy")).where(F.col("graded") >= least)


def gate(now: DataFrame, before: DataFrame, max_drop: float) -> DataFrame:
    """(metric, before, now, passes) of two one-metric-a-row tables."""
    both = now.join(before.withColumnRenamed("value", "before"), "metric")
    return both.select("metric", "before", F.col("value").alias("now"), (F.col("before") - F.col("value") <= max_drop).alias("passes"))
