"""Types of the links in page bodies: by the words around each mention, by who attended, and by the role of the page's person.

A body is cut at its links and at its lines, both with offsets; windows along a page give each line the section it stands in and each
mention its line. Every mention has its own surroundings; of a target's mentions the first with a verb decides. Where none has one, a
person's page lends companies the role it states, unless they stand in machine-written lists alone.

Defined results: code holds no link; a null body or type gives none or a page of no special type; anchors and aliases are no part of a target; a page
may be of any length and have any number of links.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.links import VERB_PHRASES
from tessera.operators.mentions import without_code

CONTEXT_CHARS = 240
# fixed values: roles of a page's person, tried in this order
ROLE_PHRASES = {
    "invested_in": r"(?i)\b(?:partner at|partner of|venture partner|VC partner|invested early|investor at|investor in|portfolio|venture capital|early-stage investor|seed investor|fund [A-Z]|invests across|backs companies)\b",
    "advises": r"(?i)\b(?:full-time advisor|professional advisor|advises (?:multiple|several|various)|is an? (?:advisor|security advisor|technical advisor|strategic advisor|industry advisor|product advisor|senior advisor)|took on advisory roles|(?:her|his|their) advisory (?:work|role|engagement|portfolio)|serves as (?:an )?advisor)\b",
    "works_at": r"(?i)\b(?:is an? (?:senior|staff|principal|lead|backend|frontend|full-?stack|ML|data|security|DevOps|platform)? ?engineer at|is an? (?:senior|staff|principal|lead)? ?(?:developer|designer|product manager|engineering manager|director|VP) (?:at|of)|holds? the (?:CTO|CEO|CFO|COO|CMO|CRO|VP) (?:role|position|seat|title) at|is the (?:CTO|CEO|CFO|COO|CMO|CRO) of|employee at|on the team at|works on .{0,30} at)\b",
}
# fixed values: headings of lists of those present, and of lists that machines write; lines that name those present
PRESENT_HEADING = r"(?i)^(?:attendees|participants)\b"
LIST_HEADING = r"(?i)^(?:timeline|see[ -]also|related|facts|sources|links|email mention links|backlinks|significant moments)\b"
PRESENT_LINE = r"(?i)^[ \t]*(?:[-*+][ \t]+)?(?:\*\*|__)?(?:attendees|participants)(?:\*\*|__)?[ \t]*:(?:\*\*|__)?"
BULLET = r"^[ \t]*(?:[-*+][ \t]+)?"
LINK_RUN = r"^(?:[\s,;&]*\[\[[^\]\n]{1,768}\]\])+"


def first_of(patterns: dict[str, str], text: Column) -> Column:
    """The first kind whose pattern occurs in a text, or null."""
    return F.coalesce(*[F.when(text.rlike(pattern), F.lit(kind)) for kind, pattern in patterns.items()])


def body_lines(pages: DataFrame) -> DataFrame:
    """(slug, no, start, line, section, present_until): the lines of bodies (slug, body) with their offsets, the kind of section they
    stand in (``present``, ``list`` or null) and where in the line the list of those present ends (null: it names none)."""
    page = Window.partitionBy("slug").orderBy("no")
    before = page.rowsBetween(Window.unboundedPreceding, -1)
    lines = pages.select("slug", F.posexplode(F.split("body", "\n")).alias("no", "line")).withColumn("start", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)))
    fence = F.col("line").rlike(r"^[ \t]*(?:```|~~~)")
    lines = lines.withColumn("fence", fence).withColumn("code", F.col("fence") | (F.coalesce(F.sum(fence.cast("int")).over(before), F.lit(0)) % 2 == 1))
    title = F.regexp_replace("line", r"^#{1,6}[ \t]+", "")
    level = F.when(~F.col("code"), F.length(F.regexp_extract("line", r"^(#{1,6})[ \t]", 1))).otherwise(0)
    kind = F.when(F.col("level") > 0, F.when(title.rlike(PRESENT_HEADING), "present").when(title.rlike(LIST_HEADING), "list"))
    lines = lines.withColumn("level", level).withColumn("kind", kind)
    # a section reaches to the next heading that is not below it; only sections outside others count
    after = page.rowsBetween(1, Window.unboundedFollowing)
    ends = [F.when(F.col("level") == n, F.min(F.when(F.col("level").between(1, n), F.col("no"))).over(after)) for n in range(1, 7)]
    lines = lines.withColumn("end", F.when(F.col("kind").isNotNull(), F.coalesce(*ends, F.lit(2**31 - 1))))
    opens = F.col("kind").isNotNull() & F.coalesce(F.col("no") >= F.max("end").over(before), F.lit(True))
    lines = lines.withColumn("open", F.last(F.when(opens, F.struct("kind", "end")), ignorenulls=True).over(page))
    lines = lines.withColumn("section", F.when(F.col("no") < F.col("open.end"), F.col("open.kind")))
    label = F.when(F.col("section").isNull(), F.regexp_extract("line", PRESENT_LINE, 0)).when(F.col("section") == "present", F.regexp_extract("line", BULLET, 0))
    named = F.when(~F.col("code") & (F.col("level") == 0) & ((F.col("section") == "present") | (F.length("label") > 0)), F.expr("substring(line, length(label) + 1)"))
    run = F.length(F.regexp_extract("named", LINK_RUN, 0))
    lines = lines.withColumn("label", label).withColumn("named", named).withColumn("run", run)
    return lines.select("slug", "no", "start", "line", "section", F.when(F.col("run") > 0, F.length("label") + F.col("run")).alias("present_until"))


def link_mentions(pages: DataFrame) -> DataFrame:
    """(slug, at, target): every link of bodies (slug, body) outside code, by the offset of its brackets."""
    parts = pages.select("slug", F.posexplode(F.split(without_code("body"), r"\[\[")).alias("i", "part"))
    before = Window.partitionBy("slug").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    target = F.trim(F.regexp_replace(F.regexp_extract("part", r"^([^\]\n|]{1,256})(?:\|[^\]\n]{1,512})?\]\]", 1), "#.*$", ""))
    return parts.withColumn("at", F.sum(F.length("part") + 2).over(before) - 2).where("i > 0").select("slug", "at", target.alias("target")).where("target <> ''")


def placed_mentions(pages: DataFrame) -> DataFrame:
    """(slug, target, at, section, present): the mentions with the section of their line and whether they stand in a list of those present."""
    lines = body_lines(pages).select("slug", F.col("start").alias("at"), F.lit(0).alias("is_mention"), F.struct("start", "section", "present_until").alias("line"), F.lit(None).cast("string").alias("target"))
    found = link_mentions(pages).select("slug", "at", F.lit(1).alias("is_mention"), F.lit(None).cast(lines.schema["line"].dataType).alias("line"), "target")
    upto = Window.partitionBy("slug").orderBy("at", "is_mention")
    both = lines.unionByName(found).withColumn("line", F.last("line", ignorenulls=True).over(upto)).where("is_mention = 1")
    return both.select("slug", "target", "at", F.col("line.section").alias("section"), F.coalesce(F.col("at") < F.col("line.start") + F.col("line.present_until"), F.lit(False)).alias("present"))


def typed_links(pages: DataFrame, resolved: DataFrame | None = None) -> DataFrame:
    """(src, target, type): each target of each page (slug, type, body) once. ``resolved`` (target, dst) says which pages targets are;
    without it a target is taken for its slug."""
    places = placed_mentions(pages)
    if resolved is not None:
        places = places.join(resolved, "target").withColumn("target", F.col("dst")).drop("dst").where(F.col("target") != F.col("slug"))
    by_page = places.groupBy("slug").agg(F.collect_list(F.struct("target", "at", "section", "present")).alias("m"))
    around = lambda m: F.substring(F.col("body"), F.greatest(m["at"] + 3 - CONTEXT_CHARS, F.lit(1)).cast("int"), (F.least(m["at"] + 2, F.lit(CONTEXT_CHARS)) + F.length(m["target"]) + CONTEXT_CHARS).cast("int"))
    each = F.transform("m", lambda m: F.struct(m["target"].alias("target"), m["at"].alias("at"), m["section"].alias("section"), m["present"].alias("present"), around(m).alias("context")))
    role = F.when(F.col("type") == "person", first_of(ROLE_PHRASES, F.col("body")))
    rows = pages.join(by_page, "slug").select("slug", "type", role.alias("role"), F.explode(each).alias("m")).select("slug", "type", "role", "m.*")
    verb = F.when(F.coalesce(~F.col("type").isin("media", "meeting"), F.lit(True)), first_of(VERB_PHRASES, F.col("context")))
    links = rows.withColumn("verb", verb).groupBy("slug", "target").agg(
        F.first("type").alias("type"), F.first("role").alias("role"), F.min_by("verb", F.when(F.col("verb").isNotNull(), F.col("at"))).alias("verb"),
        F.bool_or("present").alias("present"), F.bool_and(F.coalesce(F.col("section") == "list", F.lit(False))).alias("listed"),
    )
    personal = ~F.col("target").contains("/") | F.concat(F.lit("/"), "target").contains("/people/")
    attended = F.when((F.col("type") == "meeting") & F.col("present") & personal, F.lit("attended"))
    prior = F.when(F.col("target").startswith("companies/") & ~F.col("listed"), F.col("role"))
    return links.select(F.col("slug").alias("src"), "target", F.coalesce(attended, "verb", prior, F.lit("mentions")).alias("type"))
