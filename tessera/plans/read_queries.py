"""Code graph, boosts, fences, timelines, fact reads, lists, mirrors and the query cache over the test tables.

The tables are read under other column names; the expressions that rename them are one text for Spark and for the SQL that checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import intents as Q
from tessera.functions import rank as R
from tessera.operators import codegraph as C
from tessera.operators import reads as D
from tessera.operators.search import top_k
from tessera.plans.registry import query, table

#: (table, columns) of each view
VIEWS = {
    "asked": ("part", ["p_partkey AS id", "concat(CASE p_partkey % 12 WHEN 0 THEN 'Who is ' WHEN 1 THEN 'latest on ' WHEN 2 THEN 'when was ' WHEN 3 THEN 'everything about ' WHEN 4 THEN 'Acme raised $5 for '"
                       " WHEN 5 THEN 'show me photos of ' WHEN 6 THEN 'list all kinds of ' WHEN 7 THEN 'what''s going on today with ' WHEN 8 THEN 'compare the two ' WHEN 9 THEN 'status on ' WHEN 10 THEN 'define ' ELSE '' END, p_name) AS q"]),
    "titled": ("part", ["p_partkey AS id", "p_name AS q", "CASE p_partkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN concat('On the ', p_name, ', again') WHEN 2 THEN concat(p_name, 's') END AS title",
                        "CASE p_partkey % 3 WHEN 0 THEN 'entity' WHEN 1 THEN 'event' ELSE 'general' END AS kind", "CASE p_partkey % 2 WHEN 0 THEN 'on' ELSE 'strong' END AS mode",
                        "concat(CASE p_partkey % 5 WHEN 0 THEN 'page://life/events/' WHEN 1 THEN 'life/diary/' WHEN 2 THEN 'page-truth://' WHEN 3 THEN 'notes/' ELSE '' END, replace(p_name, ' ', '-')) AS path"]),
    "chunks": ("orders JOIN part ON p_partkey = o_custkey", ["o_orderkey AS chunk_id", "CAST(floor(o_orderkey / 8) AS BIGINT) AS document_id", "p_name AS symbol_name", "CASE WHEN o_orderkey % 8 < 7 THEN concat(p_type, '::', p_name) END AS symbol_qualified",
                        "CASE WHEN o_orderkey % 8 <> 6 THEN (o_orderkey % 8) * 10 - 9 END AS start_line", "(o_orderkey % 8) * 10 + 5 AS end_line"]),
    "mentions": ("orders JOIN part ON p_partkey = o_custkey", ["o_orderkey AS chunk_id", "p_name AS surface_form",
                          "CASE o_orderkey % 4 WHEN 0 THEN 'code-def' WHEN 1 THEN 'code-ref' WHEN 2 THEN 'code-caller' ELSE 'code-callee' END AS kind",
                          "CASE WHEN o_orderkey % 4 <> 3 THEN p_name WHEN p_partkey % 4 = 0 THEN 'db::query' WHEN p_partkey % 4 = 1 THEN 'a.b.urlopen' WHEN p_partkey % 4 = 2 THEN 'system' ELSE 'fs::open.f' END AS name"]),
    "sources": ("part", ["p_partkey AS document_id", "concat('src/', p_partkey % 100, '/', p_size) AS source_path", "CASE WHEN p_partkey % 3 > 0 THEN concat('s', p_partkey % 3) END AS source_id"]),
    "pages_": ("customer", ["c_custkey AS id", "concat(CASE c_custkey % 5 WHEN 0 THEN 'life/diary/' WHEN 1 THEN 'life/events/' WHEN 2 THEN 'meetings/' WHEN 3 THEN 'wiki/agents/' ELSE 'notes/' END, c_custkey) AS slug",
                            "CASE c_custkey % 7 WHEN 0 THEN 'diary' WHEN 1 THEN 'event' WHEN 2 THEN 'meeting' WHEN 3 THEN 'conversation' WHEN 4 THEN 'journal' WHEN 5 THEN 'note' END AS type", "c_name AS title",
                            "repeat('x', CAST(c_nationkey * 10 AS INT)) AS body", "CASE WHEN c_custkey % 11 = 0 THEN DATE '2024-01-01' END AS deleted_at", "c_custkey % 13 = 0 AS generated",
                            "CASE WHEN c_custkey % 4 > 0 THEN concat('s', c_custkey % 4) END AS source_id", "CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS compiled_truth"]),
    "happened": ("orders JOIN customer ON c_custkey = o_custkey", ["o_orderkey AS id", "concat(CASE c_custkey % 5 WHEN 0 THEN 'life/diary/' WHEN 1 THEN 'life/events/' WHEN 2 THEN 'meetings/' WHEN 3 THEN 'wiki/agents/' ELSE 'notes/' END, c_custkey) AS slug",
                            "CASE WHEN o_orderkey % 3 = 0 THEN concat(CASE (o_orderkey % 50) % 5 WHEN 0 THEN 'life/diary/' WHEN 1 THEN 'life/events/' WHEN 2 THEN 'meetings/' WHEN 3 THEN 'wiki/agents/' ELSE 'notes/' END, o_orderkey % 50) END AS event_slug",
                            "CAST(o_orderdate AS DATE) AS occurred_at", "o_orderpriority AS event", "CASE WHEN c_custkey % 4 > 0 THEN concat('s', c_custkey % 4) END AS source_id"]),
    "facts_": ("orders", ["o_orderkey AS id", "o_custkey AS entity_slug", "CAST(o_orderkey % 3 AS STRING) AS source_id", "(o_orderkey % 10) / 10.0 AS confidence", "CAST(o_orderdate AS DATE) AS created_at", "CASE WHEN o_orderkey % 6 = 0 THEN CAST(o_orderdate AS DATE) END AS forgotten_at",
                          "CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey + 1 END AS superseded_by", "CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderdate AS DATE) END AS superseded_at", "CASE WHEN o_orderkey % 7 = 0 THEN 1 END AS consolidated_into",
                          "CASE o_orderkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS severity"]),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, columns = VIEWS[name]
    first, _, other = source.partition(" JOIN ")
    rows = table(spark, sf_dir, first)
    if other:
        second, _, condition = other.partition(" ON ")
        rows = rows.join(table(spark, sf_dir, second), F.expr(condition))
    return rows.selectExpr(*columns)


def views(*names: str) -> str:
    """WITH clauses of views, for SQL."""
    return "WITH " + ", ".join(f"{n} AS (SELECT {', '.join(VIEWS[n][1])} FROM {VIEWS[n][0]})" for n in names)


def like(patterns: tuple[str, ...], column: str = "q") -> str:
    return "regexp_matches({}, '{}')".format(column, Q.any_of(patterns).replace("'", "''"))


@query(f"""{views("asked")}, t AS (SELECT *, CASE WHEN {like(Q.FULL_CONTEXT)} OR {like(Q.TEMPORAL)} THEN 'temporal' WHEN {like(Q.EVENT)} THEN 'event' WHEN {like(Q.ENTITY)} THEN 'entity' ELSE 'general' END AS taxonomy, {like(Q.CANONICAL)} AND NOT {like(Q.TIME_BOUND)} AS settled FROM asked)
SELECT id, taxonomy, CASE taxonomy WHEN 'entity' THEN 'low' WHEN 'temporal' THEN 'high' WHEN 'event' THEN 'high' END AS detail, CASE WHEN settled THEN 'off' WHEN {like(Q.STRONG_RECENCY)} THEN 'strong' WHEN {like(Q.RECENCY_ON)} THEN 'on' ELSE 'off' END AS recency,
CASE WHEN NOT settled AND {like(Q.SALIENCE_ON)} THEN 'on' ELSE 'off' END AS salience, CASE WHEN {like(Q.IMAGES)} THEN 'image' ELSE 'text' END AS modality,
len(regexp_extract_all(q, '\\S*\\w\\S*')) >= 3 AND {like(R.SET_CUES)} AND NOT {like(R.NAMED_THING)} AS concept_shaped FROM t""")
def question_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of each question, what suits it, and whether it asks for a set."""
    return view(spark, sf_dir, "asked").withColumns(Q.suggestions(F.col("q"))).withColumn("concept_shaped", R.concept_shaped(F.col("q"))).drop("q")


STOP = ", ".join(f"'{w}'" for w in R.TITLE_STOPWORDS)


@query(rf"""{views("titled")}, w AS (SELECT *, regexp_extract_all(lower(q), '[\p{{L}}\p{{N}}]+') AS a, regexp_extract_all(lower(coalesce(title, '')), '[\p{{L}}\p{{N}}]+') AS b FROM titled),
m AS (SELECT *, len(b) > 0 AND (a = b OR (len(list_filter(a, lambda x: x NOT IN ({STOP}))) >= 2 AND contains(' ' || array_to_string(b, ' ') || ' ', ' ' || array_to_string(a, ' ') || ' '))) AS phrase,
coalesce(lower(path) = lower(q) OR lower(path) = replace(lower(q), ' ', '-') OR ends_with(lower(path), '/' || replace(lower(q), ' ', '-')) OR lower(title) = lower(q), lower(path) = replace(lower(q), ' ', '-') OR ends_with(lower(path), '/' || replace(lower(q), ' ', '-'))) AS exact FROM w)
SELECT id, phrase, CASE WHEN exact AND kind = 'entity' THEN 1.25 WHEN exact AND kind = 'event' THEN 1.1 ELSE 1.0 END::DOUBLE AS f_exact,
CASE WHEN path LIKE 'page://life/events/%' OR path LIKE 'life/diary/%' THEN CASE mode WHEN 'on' THEN 1.15 ELSE 1.25 END ELSE 1.0 END::DOUBLE AS f_chronicle, CASE WHEN path LIKE 'page-truth://%' AND mode = 'on' THEN 2.0 ELSE 1.0 END::DOUBLE AS f_truth FROM m""")
def match_boosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title phrase, exact match, chronicle and compiled-truth multipliers."""
    t = view(spark, sf_dir, "titled")
    exact = R.exact_boost(F.col("kind"), R.exact_match(F.col("q"), F.col("path"), F.col("title")))
    truth = R.truth_boost(F.col("path"), F.when(F.col("mode") == "on", "low"))
    return t.select("id", R.title_phrase(F.col("q"), F.col("title")).alias("phrase"), exact.alias("f_exact"), R.chronicle_boost(F.col("path"), F.col("mode")).alias("f_chronicle"), truth.alias("f_truth"))


NAMES_SQL = "names AS (SELECT DISTINCT p_name AS name FROM part WHERE p_partkey % 20 = 0)"


def names_asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where("p_partkey % 20 = 0").select(F.col("p_name").alias("name")).distinct().withColumn("query_id", F.col("name"))


def mention_sql(kind: str, k: int, scope: str = "true") -> str:
    return f"""SELECT * FROM (SELECT name AS query_id, row_number() OVER (PARTITION BY name ORDER BY source_path, start_line NULLS FIRST, chunk_id) AS place, surface_form, chunk_id, m.document_id, source_path
FROM (SELECT DISTINCT mentions.*, document_id, start_line FROM mentions JOIN chunks USING (chunk_id)) m JOIN names USING (name) JOIN sources s ON s.document_id = m.document_id WHERE kind = '{kind}' AND {scope}) WHERE place <= {k}"""


def code_views(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(view(spark, sf_dir, n) for n in ("mentions", "chunks", "sources"))


@query(f"{views('mentions', 'chunks', 'sources')}, {NAMES_SQL} {mention_sql('code-def', 20)}")
def code_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where names are defined."""
    m, c, s = code_views(spark, sf_dir)
    return C.mentions_of(m, c, s, names_asked(spark, sf_dir), "code-def", 20)


@query(f"{views('mentions', 'chunks', 'sources')}, {NAMES_SQL} {mention_sql('code-ref', 20)}")
def code_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where names are referred to."""
    m, c, s = code_views(spark, sf_dir)
    return C.mentions_of(m, c, s, names_asked(spark, sf_dir), "code-ref", 20)


@query(f"""{views('mentions', 'chunks', 'sources')}, {NAMES_SQL} {mention_sql('code-caller', 20, "source_id IN ('s1')")}""")
def code_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who calls names, within one tenant."""
    m, c, s = code_views(spark, sf_dir)
    return C.mentions_of(m, c, s, names_asked(spark, sf_dir), "code-caller", 20, ["s1"])


@query(f"""{views("mentions", "chunks")}, i AS (SELECT document_id, symbol_qualified, chunk_id, row_number() OVER (PARTITION BY document_id ORDER BY start_line DESC, end_line, chunk_id) AS n FROM chunks WHERE document_id % 20 = 0 AND 25 BETWEEN start_line AND end_line AND symbol_qualified IS NOT NULL)
SELECT DISTINCT document_id AS query_id, symbol_qualified AS caller, name AS callee, CASE name WHEN 'db::query' THEN 'db_call' WHEN 'a.b.urlopen' THEN 'http_call' WHEN 'system' THEN 'process_exec' ELSE 'unknown' END AS sink FROM i JOIN mentions USING (chunk_id) WHERE n = 1 AND kind = 'code-callee'""")
def code_callees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls made in the symbol around a line, with what they reach."""
    m, c, _ = code_views(spark, sf_dir)
    lines = table(spark, sf_dir, "part").where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("query_id"), F.col("p_partkey").alias("document_id"), F.lit(25).alias("line"))
    return C.callees_at(m, c, lines)


@query(f"{views('chunks')}, {NAMES_SQL}, r AS (SELECT DISTINCT name AS query_id, symbol_qualified FROM chunks JOIN names ON name = symbol_name OR name = symbol_qualified WHERE symbol_qualified IS NOT NULL) SELECT query_id, symbol_qualified FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY symbol_qualified) AS n FROM r) WHERE n <= 25")
def code_disambiguation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Qualified names that bare names may mean."""
    return C.disambiguated(view(spark, sf_dir, "chunks"), names_asked(spark, sf_dir))


@query(f"""{views("chunks")}, e AS (SELECT document_id, symbol_name AS caller, symbol_qualified AS callee FROM chunks WHERE symbol_qualified IS NOT NULL)
SELECT * FROM e WHERE document_id % 5 <> 0 UNION ALL SELECT DISTINCT document_id, callee, caller FROM e WHERE document_id % 5 = 0 AND document_id % 10 = 0""")
def code_edge_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of some documents replaced, and emptied where nothing new was written."""
    e = view(spark, sf_dir, "chunks").where("symbol_qualified IS NOT NULL").select("document_id", F.col("symbol_name").alias("caller"), F.col("symbol_qualified").alias("callee"))
    written = e.where("document_id % 10 = 0").select("document_id", F.col("callee").alias("caller"), F.col("caller").alias("callee"))
    return C.replaced_edges(e, written, table(spark, sf_dir, "part").where("p_partkey % 5 = 0").select(F.col("p_partkey").alias("document_id")))


@query(f"{views('chunks', 'mentions')} SELECT least(50, (SELECT count(*) FROM chunks WHERE symbol_qualified IS NOT NULL)) AS symbols, least(50, (SELECT count(*) FROM mentions WHERE kind = 'code-def')) AS mentions, 'ready' AS state")
def code_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the code graph can answer, by capped counts."""
    m, c, _ = code_views(spark, sf_dir)
    return C.readiness(c, m, "code-def", 50)


DIARY_SQL = "(coalesce({0}.type IN ('diary', 'journal'), false) OR coalesce(starts_with({0}.slug, 'life/diary/'), false))"


@query(f"""{views("pages_")} SELECT id, CASE WHEN generated THEN 'dream_generated' WHEN {DIARY_SQL.format("p")} THEN 'diary_excluded' WHEN type = 'event' OR slug LIKE 'life/events/%' THEN 'event_self' WHEN slug LIKE 'wiki/agents/%' THEN 'subagent_scratch'
WHEN length(body) < 80 THEN 'too_short' WHEN type IN ('meeting', 'conversation', 'calendar-event') OR slug LIKE 'meetings/%' THEN 'ok' ELSE 'kind:' || coalesce(type, '') END AS verdict FROM pages_ p""")
def chronicle_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why events are read from a page or not."""
    return view(spark, sf_dir, "pages_").select("id", D.chronicle_verdict(F.col("type"), F.col("slug"), F.col("body"), F.col("generated")).alias("verdict"))


@query(f"{views('pages_')} SELECT id FROM (SELECT id, CASE WHEN id % 2 = 0 THEN 'page://s1/' ELSE 'page-truth://' END || slug AS path FROM pages_) WHERE path NOT LIKE '%/life/diary/%'")
def diary_fenced_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search hits without private pages."""
    p = view(spark, sf_dir, "pages_")
    return D.fenced(p.withColumn("source_path", F.concat(F.when(F.col("id") % 2 == 0, "page://s1/").otherwise("page-truth://"), "slug")), False).select("id")


@query(f"""{views("pages_", "happened")} SELECT e.id, e.slug, e.event_slug FROM happened e JOIN pages_ p ON p.slug = e.slug AND p.deleted_at IS NULL LEFT JOIN pages_ ep ON ep.slug = e.event_slug
WHERE (e.event_slug IS NULL OR ep.deleted_at IS NULL) AND NOT {DIARY_SQL.format("p")} AND NOT {DIARY_SQL.format("ep")}""")
def timeline_fence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of live, public pages."""
    return D.timeline_rows(view(spark, sf_dir, "happened"), view(spark, sf_dir, "pages_")).select("id", "slug", "event_slug")


@query(f"{views('happened')} SELECT * FROM (SELECT id, slug, row_number() OVER (PARTITION BY slug ORDER BY occurred_at DESC, id DESC) AS place FROM happened WHERE slug LIKE 'meetings/%' AND occurred_at BETWEEN DATE '1993-01-01' AND DATE '1997-12-31') WHERE place <= 5")
def entity_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last events of pages in a span of days."""
    slugs = view(spark, sf_dir, "pages_").where("slug LIKE 'meetings/%'")
    day = lambda d: F.lit(d).cast("date")
    return D.timeline_of(view(spark, sf_dir, "happened"), slugs, day("1993-01-01"), day("1997-12-31"), 5).select("id", "slug", "place")


@query(f"{views('pages_', 'happened')} SELECT id FROM pages_ p WHERE id % 3 > 0 AND NOT EXISTS (SELECT 1 FROM happened e WHERE e.slug = p.slug AND e.source_id IS NOT DISTINCT FROM p.source_id AND e.id % 4 = 0)")
def timeline_unanchored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mirrored pages without an event of their source."""
    p = view(spark, sf_dir, "pages_")
    return D.unanchored(p, p.where("id % 3 > 0").select("slug"), view(spark, sf_dir, "happened").where("id % 4 = 0")).select("id")


@query(f"""{views("happened")}, r AS (SELECT *, id % 2 = 1 AS new FROM happened) SELECT id, event_slug, occurred_at, event FROM r WHERE event_slug IS NULL
UNION ALL SELECT id, event_slug, occurred_at, event FROM (SELECT *, row_number() OVER (PARTITION BY source_id, event_slug, occurred_at ORDER BY new DESC, event, id) AS n FROM r WHERE event_slug IS NOT NULL) WHERE n = 1""")
def event_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events keyed by source, page and day after new ones were put."""
    e = view(spark, sf_dir, "happened").withColumn("event", F.concat("event", F.lpad(F.col("id").cast("string"), 12, "0")))
    out = D.projected_events(e.where("id % 2 = 0"), e.where("id % 2 = 1"))
    return out.select("id", "event_slug", "occurred_at", F.expr("substring(event, 1, length(event) - 12)").alias("event"))


@query(f"""{views("happened")}, s AS (SELECT DISTINCT slug, occurred_at AS day, event FROM happened WHERE id % 3 > 0), p AS (SELECT DISTINCT slug, occurred_at AS day, event FROM happened WHERE id % 3 < 2)
SELECT slug, day, event, CASE WHEN a = 1 AND b = 1 THEN 'keep' WHEN b = 1 THEN 'insert' ELSE 'delete' END AS action FROM (SELECT slug, day, event, max(a) AS a, max(b) AS b FROM (SELECT *, 1 AS a, 0 AS b FROM s UNION ALL SELECT *, 0, 1 FROM p) GROUP BY ALL)""")
def timeline_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What brings stored timeline lines to those bodies state."""
    e = view(spark, sf_dir, "happened").withColumn("day", F.col("occurred_at"))
    return D.synced_timeline(e.where("id % 3 > 0"), e.where("id % 3 < 2"))


@query(f"{views('facts_')} SELECT f.id, entity_slug FROM facts_ f JOIN (SELECT DISTINCT o_orderkey AS id FROM orders WHERE o_orderkey % 20 = 0) USING (id) WHERE forgotten_at IS NULL")
def facts_recalled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live facts by id."""
    f = view(spark, sf_dir, "facts_")
    return D.recalled(f, f.where("id % 20 = 0")).select("id", "entity_slug")


@query(f"{views('facts_')} SELECT id, superseded_by FROM facts_ WHERE superseded_by IS NOT NULL ORDER BY superseded_at DESC, id DESC LIMIT 25")
def supersession_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts superseded last."""
    return D.supersessions(view(spark, sf_dir, "facts_"), 25).select("id", "superseded_by")


@query(f"{views('facts_')} SELECT * FROM (SELECT id, entity_slug, row_number() OVER (PARTITION BY entity_slug ORDER BY confidence DESC, created_at DESC, id) AS place FROM facts_ WHERE superseded_by IS NULL) WHERE place <= 3")
def hot_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surest facts of each entity that nothing superseded."""
    return D.hot(view(spark, sf_dir, "facts_"), 3).select("id", "entity_slug", "place")


@query(f"""{views("facts_")}, r AS (SELECT a.id, min(b.id) AS new FROM facts_ a JOIN facts_ b ON b.entity_slug = a.entity_slug AND b.id > a.id GROUP BY 1) SELECT f.id, coalesce(f.superseded_by, r.new) AS superseded_by FROM facts_ f LEFT JOIN r ON r.id = f.id AND f.id % 6 = 1""")
def facts_superseded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts that a later one of the entity supersedes, unless one already does; replacements across entities are refused."""
    f = view(spark, sf_dir, "facts_")
    later = f.select("id", "entity_slug", F.lead("id").over(Window.partitionBy("entity_slug").orderBy("id")).alias("new_id"))
    pairs = later.where("id % 6 = 1 AND new_id IS NOT NULL").select(F.col("id").alias("old_id"), "new_id")
    strangers = f.select(F.col("id").alias("old_id"), F.lit(-1).cast("long").alias("new_id"))
    return D.superseded(f, pairs.unionByName(strangers)).select("id", "superseded_by")


@query(f"{views('facts_')} SELECT source_id, entity_slug, count(*) AS n FROM facts_ WHERE forgotten_at IS NULL AND consolidated_into IS NULL GROUP BY 1, 2 HAVING count(*) >= 3")
def crowded_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities with enough open facts to consolidate."""
    return D.crowded_entities(view(spark, sf_dir, "facts_"))


@query("SELECT s_suppkey AS id, CASE s_suppkey % 6 WHEN 0 THEN 'role' WHEN 1 THEN 'risk_tolerance' WHEN 2 THEN 'employer' WHEN 3 THEN 'shoe_size' WHEN 4 THEN 'affect' ELSE 'communication_style' END AS dimension, s_suppkey % 6 = 3 AS novel FROM supplier")
def dimension_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimension names in one form, and those not known."""
    names = F.array(*map(F.lit, ("Job-Role", " risk  APPETITE", "org", "shoe size", "Affect", "comms style")))
    s = table(spark, sf_dir, "supplier").withColumn("name", F.element_at(names, (F.col("s_suppkey") % 6 + 1).cast("int")))
    return s.select(F.col("s_suppkey").alias("id"), D.dimension(F.col("name")).alias("dimension"), D.novel_dimension(F.col("name")).alias("novel"))


@query("SELECT c_custkey AS id, c_name FROM customer WHERE c_custkey > 40 ORDER BY c_custkey LIMIT 30")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page of rows past a cursor."""
    return D.after(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_name"), "id", 40, 30)


@query("""SELECT slug, round(salience / (1 + greatest(date_diff('day', updated_at, DATE '1998-12-01'), 0)), 9) AS score FROM (SELECT o_orderkey AS slug, o_totalprice / 1000 AS salience, CAST(o_orderdate AS DATE) AS updated_at FROM orders)
ORDER BY salience / (1 + greatest(date_diff('day', updated_at, DATE '1998-12-01'), 0)) DESC, updated_at DESC, slug LIMIT 20""")
def recently_salient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by salience that fades with days."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("slug"), (F.col("o_totalprice") / 1000).alias("salience"), F.col("o_orderdate").cast("date").alias("updated_at"))
    return D.recently_salient(o, F.lit("1998-12-01").cast("date"), 20).select("slug", F.round("score", 9).alias("score"))


@query(f"{views('facts_')} SELECT id, CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END AS grade FROM facts_ WHERE id % 50 = 0 ORDER BY grade DESC, confidence DESC, created_at DESC, id LIMIT 15")
def gravest_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by severity, sureness and time."""
    f = view(spark, sf_dir, "facts_").where("id % 50 = 0").withColumn("at", F.col("created_at"))
    return D.by_severity(f, 15).select("id", "grade")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderpriority = '1-URGENT' AND (contains(CAST(o_custkey AS VARCHAR), '7') OR contains(CAST(o_orderkey AS VARCHAR), '7')) ORDER BY CAST(o_orderdate AS DATE) DESC, id DESC LIMIT 10")
def contradiction_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest contradictions that name something."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("src"), F.col("o_orderkey").cast("string").alias("dst"), F.when(F.col("o_orderpriority") == "1-URGENT", "contradicts").otherwise("x").alias("type"), F.col("o_orderdate").cast("date").alias("at"))
    return D.contradiction_edges(o, "7", 10).select("id")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '5-LOW' ORDER BY o_totalprice DESC, id LIMIT 10 OFFSET 10")
def takes_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page of takes by status and kind."""
    o = table(spark, sf_dir, "orders")
    return D.listed(o, [F.desc("o_totalprice"), F.col("o_orderkey")], 10, 10, o_orderstatus="F", o_orderpriority="5-LOW", o_custkey=None).select(F.col("o_orderkey").alias("id"))


@query("SELECT user_id AS session, count(*) AS turns FROM events GROUP BY 1 ORDER BY max(ts) DESC, 1 LIMIT 10")
def recent_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions heard from last."""
    return D.recent_sessions(table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("ts").alias("at")), 10).select("session", "turns")


@query("SELECT user_id AS client_id, round(sum(value), 4) AS cents FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-05 18:00:00' GROUP BY 1")
def day_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each client spent since midnight."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("client_id"), F.col("ts").alias("at"), F.col("value").alias("cents"))
    return D.day_spend(e, F.lit("2024-01-05 18:00:00").cast("timestamp_ntz")).select("client_id", F.round("cents", 4).alias("cents"))


@query("SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'events', count(*) FROM events")
def table_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row counts of tables."""
    return D.snapshot({n: table(spark, sf_dir, n) for n in ("documents", "pages", "events")})


@query("WITH u AS (SELECT count(*) AS unused FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')) SELECT count(*) AS things, (SELECT unused FROM u) AS unused, round(1 - (SELECT unused FROM u) / count(*), 6) AS share_used FROM customer")
def usage_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many things two kinds of use leave out."""
    use = lambda s: table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("c_custkey"))
    return D.unused_both_ways(table(spark, sf_dir, "customer"), use("F"), use("P"), "c_custkey").withColumn("share_used", F.round("share_used", 6))


@query("SELECT conv_id AS document_id, string_agg(text, chr(10) ORDER BY turn, text) AS text FROM conversations GROUP BY 1")
def document_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts put together from their parts."""
    return D.document_texts(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("chunk_index"), F.col("text").alias("content")))


@query("SELECT l_orderkey AS document_id, min(l_linenumber) AS id FROM lineitem GROUP BY 1")
def head_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first chunk of each document."""
    return D.head_chunks(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("id")))


@query("SELECT p.doc_id AS ref, md5(p.text) AS claim_hash, EXISTS (SELECT 1 FROM documents t WHERE t.doc_id % 3 = 0 AND t.source = p.source AND md5(t.text) = md5(p.text)) AS known FROM documents p WHERE text IS NOT NULL")
def known_takes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposed claims that are stored already."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.col("source").alias("ref"), F.md5("text").alias("claim_hash"))
    return D.known_takes(d, d.where("doc_id % 3 = 0")).select(F.col("doc_id").alias("ref"), "claim_hash", "known")


@query("SELECT doc_id FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id AND d.lang = 'en')")
def orphan_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose parent is gone."""
    return D.orphan_rows(table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").where("lang = 'en'"), "doc_id", "doc_id").select("doc_id")


@query("SELECT event_id AS document_id, CASE WHEN user_id % 3 = 0 THEN event_type END AS flag_reason, CASE WHEN user_id % 3 = 0 THEN CASE WHEN user_id % 2 = 0 THEN 'd' ELSE '' END END AS flag_detail FROM events")
def content_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits with the flags of their documents."""
    e = table(spark, sf_dir, "events")
    flag = F.struct(F.col("event_type").alias("reason"), F.when(F.col("user_id") % 2 == 0, "d").alias("detail"))
    fields = F.to_json(F.struct(F.when(F.col("user_id") % 3 == 0, flag).alias("content_flag")))
    return D.flagged_hits(e.select(F.col("event_id").alias("document_id")), e.select(F.col("event_id").alias("document_id"), fields.alias("fields")))


@query(f"{views('pages_')} SELECT id, coalesce(source_id, 'default') IN ('s1', 'default') AND id % 2 = 0 AS alias_hit, round(CASE WHEN coalesce(source_id, 'default') IN ('s1', 'default') AND id % 2 = 0 THEN id * 1.05 ELSE id END, 6)::DOUBLE AS score FROM pages_")
def alias_boosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits that an alias stands for score more."""
    p = view(spark, sf_dir, "pages_").withColumn("score", F.col("id").cast("double"))
    aliases = p.where("id % 2 = 0 AND coalesce(source_id, 'default') IN ('s1', 'default')").select("source_id", F.col("slug").alias("canonical_slug"))
    return D.alias_boosted(p, aliases.unionByName(aliases)).select("id", "alias_hit", F.round("score", 6).alias("score"))


@query(f"""{views("pages_")} SELECT 'page://' || slug AS source_path, '# ' || title || chr(10) || chr(10) || body AS content FROM pages_ WHERE deleted_at IS NULL
UNION ALL SELECT 'page-truth://' || slug, '{{"slug":"' || slug || '","title":"' || title || '","compiled_truth":"' || compiled_truth || '"}}' FROM pages_ WHERE deleted_at IS NULL AND compiled_truth IS NOT NULL""")
def page_mirrors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and compiled truths as documents to search."""
    return D.page_mirrors(view(spark, sf_dir, "pages_"))


@query("""WITH r AS (SELECT user_id AS slug, event_type AS source, props AS data, ts, event_id % 2 = 1 AS new FROM events), m AS (SELECT *, row_number() OVER (PARTITION BY slug, source ORDER BY new DESC, ts DESC, data DESC) AS n, bool_and(new) OVER (PARTITION BY slug, source) AS created FROM r) SELECT slug, source, data, created FROM m WHERE n = 1""")
def raw_sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw data of pages by source, the last write of each."""
    e = table(spark, sf_dir, "events")
    part = lambda odd: e.where(F.col("event_id") % 2 == odd).select(F.col("user_id").alias("slug"), F.col("event_type").alias("source"), F.col("props").alias("data"), F.col("ts").alias("fetched_at"))
    return D.kept_raw(part(0), part(1)).drop("fetched_at")


@query("SELECT event_id AS id, event_type AS kind FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 20")
def ingest_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An appended log, read by kind, newest first."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.col("ts").alias("at"))
    return D.listed(D.logged(e.where("id % 2 = 0"), e.where("id % 2 = 1")), [F.desc("at"), F.col("id")], 20, kind="error").select("id", "kind")


@query("SELECT o_orderkey AS cache_key, CASE WHEN o_orderkey % 4 = 0 THEN 'new' ELSE 'old' END AS intent, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n FROM orders WHERE o_orderkey % 4 = 0 AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def query_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers put into the query cache and read back by exact key; entries of an older clock are not served."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("cache_key")).agg(F.collect_list(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey")).alias("result_ids"))
    ids = lines.select(F.explode("result_ids").alias("document_id")).distinct().withColumn("generation", F.lit(1))
    entry = lambda clock, intent: lines.select("cache_key", F.lit(clock).alias("clock"), F.lit(intent).alias("intent"), "result_ids")
    old = D.cache_with(entry(1, "old").withColumn("doc_generations", F.expr("cast(null as map<string, int>)")).limit(0), entry(1, "old"), ids)
    cache = D.cache_with(old, entry(2, "new").where("cache_key % 4 = 0"), ids)
    return D.cached_exactly(cache, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("cache_key")), 2).select("cache_key", "intent", F.size("result_ids").cast("long").alias("n"))


@query("""WITH h AS (SELECT user_id AS query_id, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events)
SELECT t.user_id AS query_id, t.event_id AS id, CASE WHEN h.rank <= 50 THEN h.rank END AS rank_keyword, CASE WHEN h.rank <= 20 THEN h.rank END AS rank_fused, CASE WHEN h.rank > 50 THEN 'keyword' WHEN h.rank > 20 THEN 'fused' END AS lost_at
FROM events t JOIN h ON h.query_id = t.user_id AND h.id = t.event_id WHERE t.event_id % 20 = 0""")
def search_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which layer of a search lost a target."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("id"), F.col("value").alias("score"))
    return D.diagnosed(e.where("id % 20 = 0").select("query_id", "id"), {"keyword": top_k(e, 50), "fused": top_k(e, 20)})


@query(f"{views('pages_', 'happened')}, v AS (SELECT slug, max_by(event, id) AS writer FROM happened GROUP BY 1) SELECT p.id FROM pages_ p LEFT JOIN v USING (slug) WHERE coalesce(writer, '') NOT IN ('1-URGENT', '2-HIGH')")
def writer_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages not last written by excluded writers."""
    log = view(spark, sf_dir, "happened").select("slug", F.col("id").alias("version_n"), F.col("event").alias("written_by"))
    return D.not_written_by(view(spark, sf_dir, "pages_"), log, ["1-URGENT", "2-HIGH"]).select("id")


@query(f"{views('pages_')} SELECT id FROM pages_ WHERE deleted_at IS NULL AND coalesce(type, '') <> 'note' AND NOT generated AND length(body) > 0")
def embeddable_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that get a vector."""
    p = view(spark, sf_dir, "pages_")
    kind = F.when(F.col("type") == "note", "code").otherwise(F.col("type"))
    return D.public(p.where(D.embeddable(F.lit(None).cast("boolean"), F.col("deleted_at"), kind, F.col("generated"), F.col("body"))), ["id", "no_such_column"])
