"""Reads and small writes over pages, events, facts and takes: fences, timelines, ledgers, lists, sidecars and the query cache.

Operators that list rows take ``k`` where the list is the feature. Orders end in a key, so ties have one outcome.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.rank import ALIAS_BOOST

# fixed values: types and folders of private pages, and of pages that events are read from
DIARY_TYPES, DIARY_FOLDER, EVENT_FOLDER, SCRATCH_FOLDER = ("diary", "journal"), "life/diary/", "life/events/", "wiki/agents/"
CHRONICLE_TYPES = ("meeting", "conversation", "calendar-event")
CHRONICLE_FOLDERS = ("meetings/", "conversations/", "cal/", "calendar/")
LEAST_BODY = 80
# fixed values: names that stand for one dimension, and the dimensions known from the start
DIMENSION_ALIASES = {
    "job_role": "role", "position": "role", "title": "role", "job_title": "role", "relationship": "relation", "rel": "relation", "risk_appetite": "risk_tolerance",
    "comms_style": "communication_style", "communication": "communication_style", "employer_name": "employer", "company": "employer", "org": "employer",
}
DIMENSIONS = ("role", "relation", "risk_tolerance", "decision_style", "communication_style", "reliability", "expertise", "affect", "location", "employer")


# fences and projections


def is_diary(kind: Column, slug: Column) -> Column:
    """Whether a page is private; a null type or slug is not."""
    return F.coalesce(kind.isin(*DIARY_TYPES), F.lit(False)) | F.coalesce(slug.startswith(DIARY_FOLDER), F.lit(False))


def is_diary_path(path: Column) -> Column:
    """Whether a search path mirrors a private page, with or without its tenant."""
    return F.coalesce(path.startswith(f"page://{DIARY_FOLDER}") | path.startswith(f"page-truth://{DIARY_FOLDER}") | path.contains(f"/{DIARY_FOLDER}"), F.lit(False))


def fenced(hits: DataFrame, operator: bool, path: str = "source_path") -> DataFrame:
    """Hits that a caller may see: all for the operator, others no private pages."""
    return hits if operator else hits.where(~is_diary_path(F.col(path)))


def chronicle_verdict(kind: Column, slug: Column, body: Column, generated: Column) -> Column:
    """``ok``, or the reason that no events are read from a page. A null body is taken to be long enough."""
    talk = F.lit(False)
    for folder in CHRONICLE_FOLDERS:
        talk = talk | slug.startswith(folder)
    return (
        F.when(generated, "dream_generated")
        .when(is_diary(kind, slug), "diary_excluded")
        .when((kind == "event") | slug.startswith(EVENT_FOLDER), "event_self")
        .when(slug.startswith(SCRATCH_FOLDER), "subagent_scratch")
        .when(F.length(body) < LEAST_BODY, "too_short")
        .when(~(F.coalesce(kind.isin(*CHRONICLE_TYPES), F.lit(False)) | talk), F.concat(F.lit("kind:"), F.coalesce(kind, F.lit(""))))
        .otherwise("ok")
    )


def embeddable(archived: Column, deleted_at: Column, kind: Column, skip: Column, content: Column) -> Column:
    """Whether a chunk gets a vector: a live document that is no code, no mark to skip, and some content."""
    unmarked = F.coalesce(kind != "code", F.lit(True)) & ~F.coalesce(skip, F.lit(False)) & ~F.coalesce(archived, F.lit(False))
    return deleted_at.isNull() & unmarked & F.coalesce(F.length(F.trim(content)) > 0, F.lit(False))


def public(rows: DataFrame, allowed: Iterable[str]) -> DataFrame:
    """The columns of an allow list that are there."""
    return rows.select(*(c for c in allowed if c in rows.columns))


def scope_of(asked: list[str] | str | None) -> list[str] | None:
    """A scope as a list without blanks: None reads everything, an empty list nothing."""
    return None if asked is None else sorted({s.strip() for s in ([asked] if isinstance(asked, str) else asked) if s and s.strip()})


def not_written_by(pages: DataFrame, log: DataFrame, writers: list[str]) -> DataFrame:
    """Pages (slug) whose last version (slug, version_n, written_by) is by none of ``writers``; pages without a version stay."""
    if not writers:
        return pages
    last = log.groupBy("slug").agg(F.max_by("written_by", "version_n").alias("_by"))
    return pages.join(last.where(F.col("_by").isin(writers)), "slug", "left_anti")


# timelines


def timeline_rows(events: DataFrame, pages: DataFrame, private: bool = False) -> DataFrame:
    """Events (id, slug, event_slug, occurred_at) of live pages (slug, type, deleted_at) whose event page, if any, is live too."""
    deep = pages.where("deleted_at IS NULL").select("slug", F.col("type").alias("_type"))
    shown = events.join(deep, "slug")
    own = pages.select(F.col("slug").alias("event_slug"), F.col("type").alias("_event_type"), F.col("deleted_at").alias("_event_gone"))
    shown = shown.join(own, "event_slug", "left").where("_event_gone IS NULL")
    if not private:
        shown = shown.where(~is_diary(F.col("_type"), F.col("slug")) & ~is_diary(F.col("_event_type"), F.col("event_slug")))
    return shown.select(*events.columns)


def timeline_of(events: DataFrame, slugs: DataFrame, since: Column, until: Column, k: int) -> DataFrame:
    """The last ``k`` events of each page (slug) in a span of days, newest first, ties by id."""
    own = events.join(slugs.select("slug").distinct(), "slug").where(F.col("occurred_at").between(since, until))
    order = Window.partitionBy("slug").orderBy(F.desc("occurred_at"), F.desc("id"))
    return own.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def unanchored(pages: DataFrame, documents: DataFrame, events: DataFrame) -> DataFrame:
    """Pages (slug, source_id) with a mirrored document but no event of the same source, null sources being equal."""
    mirrored = pages.join(documents.select("slug").distinct(), "slug", "left_semi")
    e = events.select(F.col("slug").alias("_slug"), F.col("source_id").alias("_source")).distinct()
    return mirrored.join(e, (F.col("slug") == F.col("_slug")) & F.col("source_id").eqNullSafe(F.col("_source")), "left_anti")


def projected_events(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Events (source_id, event_slug, occurred_at, event, ...) after new ones replaced those of the same source, page and day."""
    keys = ["source_id", "event_slug", "_day"]
    dated = lambda df, turn: df.withColumns({"_day": F.to_date("occurred_at"), "_turn": F.lit(turn)})
    rows = dated(stored, 0).unionByName(dated(new, 1))
    keyed = rows.where("event_slug IS NOT NULL").withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_turn"), F.desc("occurred_at"), "event")))
    return keyed.where("_n = 1").select(*stored.columns).unionByName(rows.where("event_slug IS NULL").select(*stored.columns))


def synced_timeline(stored: DataFrame, parsed: DataFrame) -> DataFrame:
    """(slug, day, event, action): what brings the stored lines of a page to those its body states: insert, delete or keep."""
    keys = ["slug", "day", "event"]
    s, p = stored.select(*keys).distinct().withColumn("_s", F.lit(True)), parsed.select(*keys).distinct().withColumn("_p", F.lit(True))
    action = F.when(F.col("_s").isNull(), "insert").when(F.col("_p").isNull(), "delete").otherwise("keep")
    return s.join(p, keys, "full_outer").select(*keys, action.alias("action"))


# facts and dimensions


def recalled(facts: DataFrame, ids: DataFrame) -> DataFrame:
    """Live facts of a table of ids (id)."""
    return facts.where("forgotten_at IS NULL").join(ids.select("id").distinct(), "id", "left_semi")


def supersessions(facts: DataFrame, k: int) -> DataFrame:
    """The ``k`` facts superseded last (superseded_by, superseded_at)."""
    return facts.where("superseded_by IS NOT NULL").orderBy(F.desc("superseded_at"), F.desc("id")).limit(k)


def hot(facts: DataFrame, k: int) -> DataFrame:
    """For each entity its ``k`` surest facts that nothing superseded, newer first among equals."""
    order = Window.partitionBy("entity_slug").orderBy(F.desc("confidence"), F.desc("created_at"), "id")
    return facts.where("superseded_by IS NULL").withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def superseded(facts: DataFrame, replacements: DataFrame) -> DataFrame:
    """Facts after replacements (old_id, new_id): only a fact not superseded yet changes, and only to another that exists in its entity.

    The new fact is looked up by id and entity together, so that many replacements by one id, as by one that is not there, do not meet in one task.
    """
    known = facts.select("id", "entity_slug")
    named = replacements.where("old_id <> new_id").join(known.withColumnRenamed("id", "old_id"), "old_id")
    real = named.join(known.withColumnRenamed("id", "new_id"), ["new_id", "entity_slug"], "left_semi")
    first = real.groupBy(F.col("old_id").alias("id"), "entity_slug").agg(F.min("new_id").alias("_new"))
    return facts.join(first, ["id", "entity_slug"], "left").withColumn("superseded_by", F.coalesce("superseded_by", "_new")).select(*facts.columns)


def dimension(name: Column) -> Column:
    """The one name of a dimension, whatever its case, spacing or alias."""
    n = F.regexp_replace(F.lower(F.trim(name)), r"[\s-]+", "_")
    out = n
    for alias, known in DIMENSION_ALIASES.items():
        out = F.when(n == alias, known).otherwise(out)
    return out


def novel_dimension(name: Column) -> Column:
    return ~dimension(name).isin(*DIMENSIONS)


# lists and counts


def after(rows: DataFrame, key: str, cursor: object, k: int) -> DataFrame:
    """One page of ``k`` rows past a cursor in key order; no cursor starts at the front."""
    return (rows if cursor is None else rows.where(F.col(key) > F.lit(cursor))).orderBy(key).limit(k)


def recently_salient(pages: DataFrame, now: Column, k: int, fading: bool = True) -> DataFrame:
    """The ``k`` most salient pages (slug, salience, updated_at), salience divided by one plus the days gone where it fades."""
    days = F.greatest(F.datediff(F.to_date(now), F.to_date("updated_at")), F.lit(0))
    score = F.col("salience") / (1 + days) if fading else F.col("salience")
    return pages.withColumn("score", score).orderBy(F.desc("score"), F.desc("updated_at"), "slug").limit(k)


def by_severity(rows: DataFrame, k: int) -> DataFrame:
    """The ``k`` gravest rows (severity, confidence, at, id): high, medium, others; surer, then newer first."""
    grade = F.when(F.col("severity") == "high", 3).when(F.col("severity") == "medium", 2).otherwise(1)
    return rows.withColumn("grade", grade).orderBy(F.desc("grade"), F.desc("confidence"), F.desc("at"), "id").limit(k)


def contradiction_edges(edges: DataFrame, named: str | None, k: int) -> DataFrame:
    """The ``k`` newest edges (src, dst, type, at, id) that state a contradiction, with a text on either side if one is given."""
    rows = edges.where("type = 'contradicts'")
    if named:
        rows = rows.where(F.lower("src").contains(named.lower()) | F.lower("dst").contains(named.lower()))
    return rows.orderBy(F.desc("at"), F.desc("id")).limit(k)


def listed(rows: DataFrame, order: list[Column], k: int, offset: int = 0, **equal: object) -> DataFrame:
    """One page of rows with the given column values, in an order that must end in a key. A filter of None is none."""
    for c, v in equal.items():
        rows = rows if v is None else rows.where(F.col(c) == F.lit(v))
    return rows.orderBy(*order).offset(offset).limit(k)


def recent_sessions(turns: DataFrame, k: int) -> DataFrame:
    """(session, turns, last_at): the ``k`` sessions (session, at) heard from last."""
    return turns.groupBy("session").agg(F.count("*").alias("turns"), F.max("at").alias("last_at")).orderBy(F.desc("last_at"), "session").limit(k)


def crowded_entities(facts: DataFrame, least: int = 3) -> DataFrame:
    """(source_id, entity_slug, n) of entities with at least ``least`` live facts that no other absorbed."""
    open_ = facts.where("forgotten_at IS NULL AND consolidated_into IS NULL AND entity_slug IS NOT NULL")
    return open_.groupBy("source_id", "entity_slug").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def day_spend(calls: DataFrame, now: Column) -> DataFrame:
    """(client_id, cents) of each client since the start of the day of ``now``, that moment included."""
    today = calls.where((F.col("at") >= F.date_trunc("day", now)) & (F.col("at") <= now))
    return today.groupBy("client_id").agg(F.sum("cents").alias("cents"))


def snapshot(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n): the rows of each table, counted in one job."""
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def unused_both_ways(things: DataFrame, first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """One row: all things, those in neither use, and the share used."""
    unused = things.join(first, key, "left_anti").join(second, key, "left_anti").agg(F.count("*").alias("unused"))
    return things.agg(F.count("*").alias("things")).crossJoin(F.broadcast(unused)).withColumn("share_used", 1 - F.try_divide("unused", "things"))  # one row each


# documents, chunks and their upkeep


def document_texts(chunks: DataFrame, separator: str = "\n") -> DataFrame:
    """(document_id, text): chunks (document_id, chunk_index, content) joined in order."""
    ordered = F.sort_array(F.collect_list(F.struct("chunk_index", "content")))
    return chunks.groupBy("document_id").agg(F.array_join(F.transform(ordered, lambda c: c["content"]), separator).alias("text"))


def head_chunks(chunks: DataFrame) -> DataFrame:
    """(document_id, id): the first chunk of each document."""
    return chunks.groupBy("document_id").agg(F.min("id").alias("id"))


def known_takes(proposals: DataFrame, takes: DataFrame) -> DataFrame:
    """Proposals (ref, claim_hash) with ``known``: whether such a take is stored."""
    stored = takes.select("ref", "claim_hash").distinct().withColumn("known", F.lit(True))
    return proposals.join(stored, ["ref", "claim_hash"], "left").withColumn("known", F.coalesce("known", F.lit(False)))


def orphan_rows(rows: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Rows whose parent is gone; a null key has no parent either."""
    return rows.join(parents.select(F.col(parent_key).alias("_parent")), F.col(key) == F.col("_parent"), "left_anti")


def flagged_hits(hits: DataFrame, documents: DataFrame) -> DataFrame:
    """Hits (document_id) with the reason and detail of the flag in a document's JSON fields (document_id, fields); null without one."""
    reason, detail = F.get_json_object("fields", "$.content_flag.reason"), F.get_json_object("fields", "$.content_flag.detail")
    flags = documents.where(F.coalesce(reason, F.lit("")) != "").select("document_id", reason.alias("flag_reason"), F.coalesce(detail, F.lit("")).alias("flag_detail"))
    return hits.join(flags, "document_id", "left")


def alias_boosted(hits: DataFrame, aliases: DataFrame) -> DataFrame:
    """Hits (source_id, slug, score) that an alias (source_id, canonical_slug) stands for score a little more; no source is ``default``."""
    named = aliases.select(F.coalesce("source_id", F.lit("default")).alias("_source"), F.col("canonical_slug").alias("slug")).distinct().withColumn("alias_hit", F.lit(True))
    met = hits.withColumn("_source", F.coalesce("source_id", F.lit("default"))).join(named, ["_source", "slug"], "left").drop("_source")
    return met.withColumns({"alias_hit": F.coalesce("alias_hit", F.lit(False)), "score": F.when(F.col("alias_hit"), F.col("score") * ALIAS_BOOST).otherwise(F.col("score"))})


def page_mirrors(pages: DataFrame) -> DataFrame:
    """(source_path, content): live pages (slug, title, body, compiled_truth) as documents, and those with a compiled truth once more as JSON."""
    shown = pages.where("deleted_at IS NULL")
    bodies = shown.select(F.concat(F.lit("page://"), "slug").alias("source_path"), F.concat_ws("\n\n", F.concat(F.lit("# "), "title"), "body").alias("content"))
    truths = shown.where("compiled_truth IS NOT NULL").select(F.concat(F.lit("page-truth://"), "slug").alias("source_path"), F.to_json(F.struct("slug", "title", "compiled_truth")).alias("content"))
    return bodies.unionByName(truths)


def kept_raw(store: DataFrame, writes: DataFrame) -> DataFrame:
    """Sidecars (slug, source, data, fetched_at), the last write of each page and source; ``created`` says that it was none before."""
    rows = store.withColumn("_new", F.lit(False)).unionByName(writes.withColumn("_new", F.lit(True)))
    last = F.max_by(F.struct("data", "fetched_at"), F.struct("_new", "fetched_at", "data")).alias("r")
    return rows.groupBy("slug", "source").agg(last, F.bool_and("_new").alias("created")).select("slug", "source", "r.data", "r.fetched_at", "created")


def logged(log: DataFrame, entries: DataFrame) -> DataFrame:
    """An ingest log with entries added; the log is append-only, so on disk this is one more file."""
    return log.unionByName(entries)


# the query cache: entries (cache_key, clock, intent, result_ids, doc_generations)


def cached_exactly(cache: DataFrame, asked: DataFrame, clock: int) -> DataFrame:
    """(cache_key, intent, result_ids): entries for the keys asked that are of this clock and hold a result."""
    fresh = cache.where((F.col("clock") == clock) & (F.size("result_ids") > 0))
    return fresh.join(asked.select("cache_key").distinct(), "cache_key", "left_semi").select("cache_key", "intent", "result_ids")


def cache_with(cache: DataFrame, answers: DataFrame, generations: DataFrame) -> DataFrame:
    """Entries after answers (cache_key, clock, intent, result_ids) are put, each with its documents' generations; a later clock replaces."""
    seen = answers.select("cache_key", F.explode("result_ids").alias("document_id")).distinct().join(generations, "document_id")
    maps = seen.groupBy("cache_key").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("document_id", "generation")))).alias("doc_generations"))
    put = answers.join(maps, "cache_key", "left").select(*cache.columns)
    return cache.join(put.select("cache_key"), "cache_key", "left_anti").select(*put.columns).unionByName(put)


def diagnosed(targets: DataFrame, layers: dict[str, DataFrame]) -> DataFrame:
    """Targets (query_id, id) with their rank in each layer (query_id, id, rank), in the order searched, and ``lost_at``, the first without them."""
    out = targets
    for name, hits in layers.items():
        out = out.join(hits.select("query_id", "id", F.col("rank").alias(f"rank_{name}")), ["query_id", "id"], "left")
    lost = F.lit(None).cast("string")
    for name in reversed(layers):
        lost = F.when(F.col(f"rank_{name}").isNull(), name).otherwise(lost)
    return out.withColumn("lost_at", lost)
