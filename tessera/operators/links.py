"""Typed links read from page bodies, fields and questions, and the searches that follow them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import csv_tags, strip_code, wikilinks
from tessera.operators.graph import connecting, traverse

# fixed values: verb phrases that give a link its type, tried in this order
VERB_PHRASES = {
    "founded": r"(?i)\b(?:founded|co-?founded|started the company|incorporated|founder of|founders? (?:include|are)|the founder|is a co-?founder|is one of the founders)\b",
    "invested_in": r"(?i)\b(?:invested in|invests in|investing in|invest in|investment in|investments in|backed by|funding from|funded by|raised from|led the (?:seed|Series|round|investment)|led .{0,30}(?:Series [A-Z]|seed|round|investment)|participated in (?:the )?(?:seed|Series|round)|wrote (?:a |the )?check|first check|early investor|portfolio (?:company|includes)|board seat (?:at|in|on)|term sheet for)\b",
    "advises": r"(?i)\b(?:advises|advised|advisor (?:to|at|for|of)|advisory (?:board|role|position|capacity|engagement|partnership|contract|relationship|work)|board advisor|on .{0,20} advisory board|joined .{0,20} advisory board|in an? advisory (?:capacity|role|position)|as an? (?:advisor|security advisor|technical advisor|strategic advisor|industry advisor|product advisor|board advisor|senior advisor)|(?:strategic|technical|security|product|industry|senior|board) advisor (?:to|at|for|of)|consults for|consulting role (?:at|with))\b",
    "works_at": r"(?i)\b(?:CEO of|CTO of|COO of|CFO of|CMO of|CRO of|VP at|VP of|VPs? Engineering|VPs? Product|works at|worked at|working at|employed by|employed at|joined as|joined the team|engineer at|engineer for|director at|director of|head of|heads up .{0,20} at|leads engineering|leads product|leads the .{0,20} (?:team|org) at|manages engineering at|manages product at|running (?:engineering|product|design) at|currently at|previously at|previously worked at|spent .* (?:years|months) at|stint at|stint as|tenure at|tenure as|role at|position at|(?:senior|staff|principal|lead|backend|frontend|full-?stack|ML|data|security) engineer at|promoted to (?:senior|staff|principal|lead) .{0,20} at|(?:his|her|their|my) time at)\b",
}
# fixed values: link types and directions that page fields stand for
FIELD_LINKS = {
    ("person", "companies"): ("works_at", "outgoing"), ("person", "founded"): ("founded", "outgoing"), ("person", "advises"): ("advises", "outgoing"), ("person", "invested_in"): ("invested_in", "outgoing"),
    ("person", "knows"): ("knows", "outgoing"), ("meeting", "attendees"): ("attended", "incoming"), ("meeting", "attended_by"): ("attended", "incoming"), ("meeting", "location"): ("located_at", "outgoing"),
    ("", "related"): ("related_to", "outgoing"), ("", "see_also"): ("related_to", "outgoing"),
}
FIELD_CONFIDENCE = 0.8
# fixed values: question shapes with link types and direction; the seed is the first group
SEED = r"[\"']?(.{1,80}?)[\"']?"
QUESTIONS = (
    (rf"(?i)\bhow\s+(?:are|is|do|does)\s+{SEED}\s+(?:and|&)\s+{SEED}\s+(?:connected|related|linked|associated)\b", "connects", None, "both"),
    (rf"(?i)\bwho\s+(?:at|from|in)\s+{SEED}\s+(?:works? on|works?|leads?|runs?|builds?|owns?|handles?|manages?)\b", "who_at", "works_at", "inbound"),
    (rf"(?i)\bwho\s+(?:invested in|invests in|funded|backed|backs)\s+{SEED}\s*\??$", "who_rel", "invested_in", "inbound"),
    (rf"(?i)\bwho\s+(?:founded|co-?founded|started)\s+{SEED}\s*\??$", "who_rel", "founded", "inbound"),
    (rf"(?i)\bwho\s+(?:advises|advised)\s+{SEED}\s*\??$", "who_rel", "advises", "inbound"),
    (rf"(?i)\bwho\s+(?:works at|worked at|works for)\s+{SEED}\s*\??$", "who_rel", "works_at", "inbound"),
    (rf"(?i)\bwho\s+attended\s+{SEED}\s*\??$", "who_rel", "attended", "inbound"),
    (rf"(?i)\bwhere\s+(?:does|did|has)\s+{SEED}\s+work\b", "who_rel", "works_at", "outbound"),
)


def page_wikilinks(pages: DataFrame) -> DataFrame:
    """(src, target): distinct wikilink targets of bodies (slug, body) without code and anchors."""
    found = pages.select(F.col("slug").alias("src"), F.explode(wikilinks(strip_code(F.col("body")))).alias("target"))
    return found.select("src", F.trim(F.regexp_replace("target", "#.*$", "")).alias("target")).where("target <> ''").distinct()


def resolved_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Links with the slug that their target names, as slug or unique title; null where it names none."""
    names = pages.select(F.lower(F.trim("slug")).alias("name"), "slug").unionAll(pages.select(F.lower(F.trim("title")), "slug")).where("name <> ''")
    unique = names.groupBy("name").agg(F.min("slug").alias("dst"), F.countDistinct("slug").alias("n")).where("n = 1").drop("n")
    return links.withColumn("name", F.lower(F.trim("target"))).join(unique, "name", "left").drop("name")


def replaced_links(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """All stored links, with those of the pages in ``fresh`` (src) replaced."""
    return stored.join(fresh.select("src").distinct(), "src", "left_anti").unionByName(fresh)


def field_links(fields: DataFrame) -> DataFrame:
    """(src, dst, type, confidence) of page fields (slug, type, field, value); the rules are a small table joined by type and field."""
    spark = fields.sparkSession
    rules = spark.createDataFrame([(*k, *v) for k, v in FIELD_LINKS.items()], "rule_type string, field string, link string, direction string")
    values = fields.select("slug", "type", "field", F.explode(csv_tags(F.col("value"))).alias("value"))
    hits = values.join(F.broadcast(rules), "field").where((F.col("rule_type") == "") | (F.col("rule_type") == F.col("type")))
    out = F.col("direction") == "outgoing"
    return hits.select(F.when(out, F.col("slug")).otherwise(F.col("value")).alias("src"), F.when(out, F.col("value")).otherwise(F.col("slug")).alias("dst"), F.col("link").alias("type"), F.lit(FIELD_CONFIDENCE).alias("confidence")).distinct()


def relational_questions(queries: DataFrame) -> DataFrame:
    """Questions (query_id, query) about relations: kind, seed, second seed, link type and direction; others are left out."""
    clean = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"^(?i:the|a|an)\s+", ""), r"\?+$", ""))
    out = F.lit(None).cast("struct<kind:string,seed:string,seed2:string,link:string,direction:string>")
    for pattern, kind, link, direction in reversed(QUESTIONS):
        second = clean(F.regexp_extract("query", pattern, 2)) if kind == "connects" else F.lit(None).cast("string")
        found = F.struct(F.lit(kind).alias("kind"), clean(F.regexp_extract("query", pattern, 1)).alias("seed"), second.alias("seed2"), F.lit(link).cast("string").alias("link"), F.lit(direction).alias("direction"))
        out = F.when(F.col("query").rlike(pattern), found).otherwise(out)
    # exploded, so that the chain of shapes is generated and run once, not once for each field
    asked = F.filter(F.array(out), lambda r: r.isNotNull() & (r["seed"] != ""))
    return queries.select("query_id", F.explode(asked).alias("r")).select("query_id", "r.*")


def relational_answers(questions: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, node): what one step along the asked links in the asked direction reaches."""
    wanted = questions.where("kind <> 'connects'")
    out = wanted.join(edges, (F.lower("src") == F.lower("seed")) & (F.col("type") == F.col("link"))).where("direction <> 'inbound'").select("query_id", F.col("dst").alias("node"))
    back = wanted.join(edges, (F.lower("dst") == F.lower("seed")) & (F.col("type") == F.col("link"))).where("direction <> 'outbound'").select("query_id", F.col("src").alias("node"))
    return out.union(back).distinct()


def between(edges: DataFrame, a: str, b: str, depth: int = 2) -> DataFrame:
    """Nodes that connect two others, by the sum of steps along links in either direction."""
    steps = edges.select("src", "dst").unionAll(edges.select("dst", "src"))
    walk = lambda n: traverse(steps, edges.sparkSession.createDataFrame([(n,)], "node string"), depth)
    return connecting(walk(a), walk(b)).where(~F.col("node").isin(a, b))


def file_references(refs: DataFrame, documents: DataFrame) -> DataFrame:
    """References (id, path) with the documents (document_id, source_path) they name: equal paths, or paths that end in ``/path``.

    An equi join: a document is listed under each tail of its path.
    """
    parts = F.split("source_path", "/")
    tails = documents.select("document_id", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("path")).distinct()
    return refs.join(tails, "path").select("id", "path", "document_id")


def alias_hop(hits: DataFrame, queries: DataFrame, aliases: DataFrame, boost: float = 1.1, most: int = 3, longest: int = 6) -> DataFrame:
    """Hits (query_id, id, score) with the pages whose alias is the whole query: boosted where present, else added at the best score."""
    short = queries.where(F.size(F.split(F.trim("query"), r"\s+")) <= longest).select("query_id", F.lower(F.trim("query")).alias("alias"))
    named = short.join(aliases.select(F.lower(F.trim("alias")).alias("alias"), "id"), "alias").select("query_id", "id").distinct().withColumn("named", F.lit(True))
    best = hits.groupBy("query_id").agg(F.max("score").alias("best"))
    merged = hits.join(named, ["query_id", "id"], "full_outer").join(best, "query_id", "left")
    added = F.col("score").isNull()
    n = F.row_number().over(Window.partitionBy("query_id", added).orderBy("id"))
    scored = merged.withColumn("_n", F.when(added, n).otherwise(0)).where(F.col("_n") <= most)
    return scored.select("query_id", "id", F.when(added, F.coalesce("best", F.lit(1.0))).when(F.col("named"), F.col("score") * boost).otherwise(F.col("score")).alias("score"))


def pointers(mentions: DataFrame, aliases: DataFrame, pages: DataFrame) -> DataFrame:
    """(mention, slug, confidence): a page by alias (0.9), title (0.8) or end of slug (0.6), the surest first."""
    norm = lambda c: F.lower(F.trim(c))
    m = mentions.select(norm(F.col("mention")).alias("mention")).distinct()
    by_alias = m.join(aliases.select(norm(F.col("alias")).alias("mention"), "slug"), "mention").withColumn("confidence", F.lit(0.9))
    by_title = m.join(pages.select(norm(F.col("title")).alias("mention"), "slug"), "mention").withColumn("confidence", F.lit(0.8))
    tail = pages.select(F.regexp_replace(F.element_at(F.split("slug", "/"), -1), "-", " ").alias("mention"), "slug")
    by_tail = m.join(tail, "mention").withColumn("confidence", F.lit(0.6))
    order = Window.partitionBy("mention").orderBy(F.desc("confidence"), "slug")
    return by_alias.unionByName(by_title).unionByName(by_tail).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def volunteered(found: DataFrame, gate: float = 0.7, cap: int = 3) -> DataFrame:
    """The surest pages (query_id, slug, confidence, boost) above the gate, at most ``cap`` a query."""
    sure = F.least(F.col("confidence") + F.coalesce("boost", F.lit(0.0)), F.lit(0.99))
    w = Window.partitionBy("query_id").orderBy(F.desc("sure"), "slug")
    return found.withColumn("sure", sure).where(F.col("sure") >= gate).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap).drop("_n")


def volunteer_precision(volunteered_at: DataFrame, retrieved: DataFrame) -> DataFrame:
    """(channel, volunteered, used, precision): a volunteered page counts as used if it was retrieved later in the session."""
    joined = volunteered_at.join(retrieved.select("session", "slug", F.col("at").alias("retrieved_at")), ["session", "slug"], "left")
    used = F.countDistinct(F.when(F.col("retrieved_at") > F.col("at"), F.col("id")))
    return joined.groupBy("channel").agg(F.countDistinct("id").alias("volunteered"), used.alias("used")).withColumn("precision", F.col("used") / F.col("volunteered"))
