"""Facts and timelines written in page bodies: tables between markers, dated bullets, headings and citations.

Lines are exploded with their number; state that runs down a page is a window over its lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: kinds of facts, and names of table columns
KINDS = ("event", "commitment", "preference", "belief", "fact")
COLUMNS = {"claim": ("claim",), "kind": ("kind",), "confidence": ("confidence", "conf"), "valid_from": ("valid_from", "valid from", "from"), "valid_until": ("valid_until", "valid until", "until"), "source": ("source", "src")}
LEGACY = {"claim": 1, "confidence": 2, "source": 3}
BEGIN, END = "<!-- facts:begin -->", "<!-- facts:end -->"
BULLET = r"^\s{0,8}[-*]\s{1,4}(?:\*\*)?(\d{4}-\d{2}-\d{2})(?:\*\*)?\s{0,4}(?:[—–:-]\s{0,4})?(.{1,2000})"
HEADER = r"^###\s{1,4}(\d{4}-\d{2}-\d{2})\s{0,4}(?:[—–:-]\s{0,4})?(.{1,500})"
CITATION = r"\[Source:([^\]]{1,290}),\s*(\d{4}-\d{2}-\d{2})\s*\]"


def page_lines(pages: DataFrame) -> DataFrame:
    """(slug, n, line) of bodies (slug, body)."""
    return pages.select("slug", F.posexplode(F.split("body", r"\r?\n")).alias("n", "line"))


def fact_rows(pages: DataFrame, begin: str = BEGIN, end: str = END) -> DataFrame:
    """(slug, row_num, claim, kind, confidence, valid_from, valid_until, source, active) of fact tables.

    The first header row names the columns, else the old order (number, claim, confidence, source) holds. A claim struck
    through is inactive; rows without a claim are left out.
    """
    w = Window.partitionBy("slug").orderBy("n")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opened = F.sum((F.trim("line") == begin).cast("int")).over(so_far)
    closed = F.sum((F.trim("line") == end).cast("int")).over(so_far)
    inside = page_lines(pages).withColumns({"_o": opened, "_c": closed}).where("_o > 0 AND _c = 0").where(F.trim("line").rlike(r"^\|.*\|$"))
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    table = inside.select("slug", "n", cells.alias("cells")).where(~F.forall("cells", lambda c: c.rlike(r"^:?-*:?$")))
    names = F.transform("cells", lambda c: F.lower(c))
    is_header = ~F.col("cells")[0].rlike(r"^[1-9][0-9]*$") & F.array_contains(names, "claim")
    marked = table.withColumn("_h", F.when(is_header, names))
    header = F.first("_h", ignorenulls=True).over(Window.partitionBy("slug").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = marked.withColumn("header", header).where("_h IS NULL").withColumn("seq", F.row_number().over(w))

    def cell(name: str) -> Column:
        at = F.greatest(*[F.array_position("header", a) for a in COLUMNS[name]], F.lit(0))
        named = F.when(at > 0, F.get("cells", at.cast("int") - 1))
        old = F.get("cells", F.lit(LEGACY[name])) if name in LEGACY else F.lit(None).cast("string")
        return F.nullif(F.trim(F.when(F.col("header").isNull(), old).otherwise(named)), F.lit(""))

    struck = cell("claim").rlike(r"^~~.*~~$")
    kind = F.when(F.lower(cell("kind")).isin(*KINDS), F.lower(cell("kind"))).otherwise("fact")
    confidence = F.least(F.greatest(F.coalesce(cell("confidence").try_cast("double"), F.lit(1.0)), F.lit(0.0)), F.lit(1.0))
    number = F.when(F.col("cells")[0].rlike(r"^[1-9][0-9]*$"), F.col("cells")[0].cast("int")).otherwise(F.col("seq"))
    out = rows.select("slug", number.alias("row_num"), F.trim(F.regexp_replace(cell("claim"), "^~~|~~$", "")).alias("claim"), kind.alias("kind"), confidence.alias("confidence"),
                      F.try_to_date(cell("valid_from")).alias("valid_from"), F.try_to_date(cell("valid_until")).alias("valid_until"), cell("source").alias("source"), (~struck).alias("active"))
    return out.where("claim <> ''")


def rendered_facts(facts: DataFrame) -> DataFrame:
    """(slug, fence): facts (slug, row_num, claim, kind, confidence, active) as a table between markers."""
    claim = F.when(F.col("active"), F.col("claim")).otherwise(F.concat(F.lit("~~"), F.col("claim"), F.lit("~~")))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", F.col("row_num").cast("string"), claim, "kind", F.col("confidence").cast("string")), F.lit(" |"))
    rows = F.transform(F.sort_array(F.collect_list(F.struct("row_num", line.alias("line")))), lambda r: r["line"])
    head = F.array(F.lit(BEGIN), F.lit("| # | claim | kind | confidence |"), F.lit("|---|---|---|---|"))
    return facts.groupBy("slug").agg(rows.alias("rows")).select("slug", F.array_join(F.concat(head, "rows", F.array(F.lit(END))), "\n").alias("fence"))


def body_timeline(pages: DataFrame, most: int = 200) -> DataFrame:
    """(slug, kind, day, event, detail): dated H3 headings, dated bullets below ``## Timeline``, and source citations elsewhere.

    Each event once a day, at most ``most`` a page, as a page shows no more.
    """
    level = F.length(F.regexp_extract("line", r"^(#{1,6})(?:\s|$)", 1))
    section = F.when(level.between(1, 2), F.when((level == 2) & (F.lower(F.trim(F.regexp_replace("line", "^##", ""))) == "timeline"), 1).otherwise(0))
    so_far = Window.partitionBy("slug").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = page_lines(pages).withColumns({"level": level, "_s": section}).withColumn("in_timeline", F.coalesce(F.last("_s", ignorenulls=True).over(so_far), F.lit(0)) == 1)
    head, bullet = F.col("line").rlike(HEADER) & (F.col("level") == 3), F.col("line").rlike(BULLET) & F.col("in_timeline") & (F.col("level") == 0)
    plain = F.trim(F.regexp_replace(F.regexp_replace("line", CITATION, ""), r"^(?:#{1,6}\s|[-*] )", ""))
    pick = lambda p, kind: F.array(F.struct(F.lit(kind).alias("kind"), F.regexp_extract("line", p, 1).alias("day"), F.trim(F.regexp_extract("line", p, 2)).alias("event"), F.lit("").alias("detail")))
    cited = F.zip_with(F.regexp_extract_all("line", F.lit(CITATION), 1), F.regexp_extract_all("line", F.lit(CITATION), 2), lambda s, d: F.struct(F.lit("citation").alias("kind"), d.alias("day"), F.when(plain != "", plain).otherwise(F.trim(s)).alias("event"), F.concat(F.lit("Source:"), s).alias("detail")))
    events = lines.select("slug", "n", F.posexplode(F.when(head, pick(HEADER, "header")).when(bullet, pick(BULLET, "bullet")).otherwise(cited)).alias("i", "e")).select("slug", "n", "i", "e.*")
    dated = events.withColumn("day", F.try_to_date("day")).where(F.year("day").between(1900, 2099) & (F.col("event") != "")).withColumn("event", F.substring("event", 1, 500))
    first = Window.partitionBy("slug", "day", "event").orderBy((F.col("kind") == "citation"), "n", "i")
    place = Window.partitionBy("slug").orderBy((F.col("kind") == "citation"), "n", "i")
    return dated.withColumn("_f", F.row_number().over(first)).where("_f = 1").withColumn("_p", F.row_number().over(place)).where(F.col("_p") <= most).select("slug", "kind", "day", "event", "detail")


def meeting_timeline(meetings: DataFrame) -> DataFrame:
    """(slug, event_slug, day, event): a meeting (slug, title, day, attendees) on its own page and on each attendee's."""
    own = meetings.select("slug", F.col("slug").alias("event_slug"), "day", F.col("title").alias("event"))
    theirs = meetings.select(F.explode(F.array_distinct("attendees")).alias("slug"), F.col("slug").alias("event_slug"), "day", F.concat(F.lit("Attended "), "title").alias("event"))
    return own.unionByName(theirs)
