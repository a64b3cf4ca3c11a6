"""Notes, logs, exports and graphs written out from the rows of the test tables and read back by the operators; the SQL
computes from the same rows what must come back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import chunking as C
from tessera.operators import fences as N
from tessera.operators import graph as G
from tessera.operators import links as L
from tessera.operators import linktypes as LT
from tessera.operators import mentions as M
from tessera.operators import upkeep as U
from tessera.plans.registry import query, table, texts
from tessera.sources import files as S
from tessera.sources import transcripts as H


def written(pattern: str, *columns: str | Column) -> Column:
    """A text with columns in the places of ``%s``."""
    return F.format_string(pattern, *columns)


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns with their place in the conversation, from 0, and whether they are its last."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf_dir, "conversations").withColumn("pos", F.row_number().over(w) - 1)
    return turns.withColumn("last", F.lead("pos").over(w).isNull())


SPOKEN = """SELECT CAST(conv_id AS VARCHAR) AS session_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS turn, role, text
FROM conversations WHERE role IN ('user', 'assistant') AND trim(text) <> ''"""


@query("""SELECT 'Order ' || o_orderkey AS first_link, 'Customer ' || o_custkey AS second_link, 2 AS n_links, 'tag' || o_custkey AS tag, strftime(o_orderdate, '%Y-%m-%d') AS day, 'notes/o' || o_orderkey AS link,
'src/app' || o_custkey || '.py' AS ref_path, CAST(o_orderkey % 1000 AS INTEGER) AS ref_line, 'x = ' || o_orderkey || chr(10) AS code FROM orders""")
def markdown_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, tags, dates, code and references of one note an order; code and implausible dates give nothing."""
    note = written(
        "# One\n\nSee [[Order %s|it]] and [[Customer %s]] #Tag%s on %s and 3024-01-01.\n\n```python\nx = %s\n```\n\n[x](../notes/o%s.md#h) `[[no]]` src/app%s.py:%s end",
        "o_orderkey", "o_custkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd"), "o_orderkey", "o_orderkey", "o_custkey", F.col("o_orderkey") % 1000,
    )
    t = F.col("note")
    found = table(spark, sf_dir, "orders").select(note.alias("note")).select(
        X.wikilinks(X.strip_code(t)).alias("w"), X.hashtags(t).alias("h"), X.iso_dates(t).alias("d"), X.markdown_links(t).alias("l"), X.code_refs(t).alias("r"), C.fenced_code(t).alias("c")
    )
    one = {"first_link": F.col("w")[0], "second_link": F.col("w")[1], "n_links": F.size("w"), "tag": F.array_join("h", ","), "day": F.array_join("d", ","), "link": F.array_join("l", ",")}
    return found.select(*(c.alias(n) for n, c in one.items()), F.col("r")[0]["path"].alias("ref_path"), F.col("r")[0]["line"].alias("ref_line"), F.col("c")[0]["code"].alias("code"))


@query("""SELECT c_name AS path, 'C' || c_custkey AS name, 'class' AS kind, 1 AS start_line, 3 AS end_line, 'f' || c_nationkey AS calls FROM customer
UNION ALL SELECT c_name, 'm', 'method', 2, 3, 'f' || c_nationkey FROM customer UNION ALL SELECT c_name, 'top' || c_custkey, 'function', 5, 6, 'C' || c_custkey || ',C' || c_custkey || '().m' FROM customer""")
def code_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols and calls of one Python file a customer; a text that does not parse gives none."""
    source = written("class C%s:\n    def m(self):\n        return f%s()\n\ndef top%s():\n    return C%s().m()", "c_custkey", "c_nationkey", "c_custkey", "c_custkey")
    # parsing costs far more than moving keys, and a file's row groups are few, so rows are dealt out
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment").repartition(4 * spark.sparkContext.defaultParallelism)
    files = c.select(F.col("c_name").alias("path"), source.alias("text")).unionAll(c.select("c_name", F.concat(F.lit("not ( "), "c_mktsegment")))
    return C.code_symbols(files).select("path", "name", "kind", "start_line", "end_line", F.array_join("calls", ",").alias("calls"))


@query("""SELECT doc_id, CASE WHEN doc_id % 10 <> 3 THEN coalesce(source, '') END AS title, CASE WHEN doc_id % 10 <> 3 THEN 'l-' || coalesce(lang, '') || ',n' || n_chars % 7 END AS tags, md5(text) AS body_hash FROM documents""")
def frontmatter_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields and body of all documents, nine in ten with a block written before their whole text."""
    block = written('---\ntitle: "%s"\ntags:\n- l-%s\n- n%s\n---\n%s', F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), F.col("n_chars") % 7, "text")
    notes = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 10 == 3, F.col("text")).otherwise(block).alias("text"))
    get = lambda k: F.array_join(F.try_element_at("f.fields", F.lit(k)), ",").alias(k)
    return notes.withColumn("f", S.frontmatter("text")).select("doc_id", get("title"), get("tags"), F.md5("f.body").alias("body_hash"))


@query("""WITH t AS (SELECT conv_id AS id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, role AS speaker, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines FROM conversations)
SELECT id, n, speaker, CASE WHEN n % 3 = 1 THEN '2024-03-15T' || lpad(CAST(n % 24 AS VARCHAR), 2, '0') || ':37:00Z' ELSE '1970-01-01T00:00:00Z' END AS "at", array_to_string(lines, chr(10)) AS text FROM t""")
def chat_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of all conversations written as logs, in three line grammars by turn; further lines of a turn continue it."""
    n = F.col("pos") + 1
    line = F.when(n % 3 == 1, written("[2024-03-15, %s:37] %s: %s", n % 24, "role", "text")).when(n % 3 == 2, written("<%s> %s", "role", "text")).otherwise(written("%s: %s", "role", "text"))
    turns = conversations(spark, sf_dir).select(F.col("conv_id").alias("id"), "pos", line.alias("line"))
    logs = turns.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return H.chat_log_messages(logs)


@query(SPOKEN)
def tree_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of all conversations written as trees with a stale first branch; half name no current node, so the latest childless one counts."""
    c = conversations(spark, sf_dir)
    node = lambda parent, child, role, at, text: F.struct(
        parent.alias("parent"), F.array_compact(F.array(child)).alias("children"),
        F.struct(F.struct(role.alias("role")).alias("author"), at.cast("double").alias("create_time"), F.struct(F.array(text).alias("parts")).alias("content")).alias("message"),
    )
    key = lambda at: F.concat(F.lit("n"), at)
    parent = F.when(F.col("pos") > 0, key(F.col("pos") - 1))
    turn = node(parent, F.when(~F.col("last"), key(F.col("pos") + 1)), F.col("role"), F.col("pos"), F.col("text"))
    stale = node(F.lit("n0"), F.lit(None).cast("string"), F.lit("assistant"), F.lit(-0.5), F.lit("stale"))
    entries = c.select("conv_id", F.struct(key(F.col("pos")).alias("key"), turn.alias("value")).alias("e"), F.when(F.col("last"), key(F.col("pos"))).alias("leaf"))
    stales = c.where("pos = 0 AND NOT last").select("conv_id", F.struct(F.lit("stale").alias("key"), stale.alias("value")), F.lit(None).cast("string"))
    trees = entries.unionAll(stales).groupBy("conv_id").agg(F.map_from_entries(F.collect_list("e")).alias("mapping"), F.max("leaf").alias("leaf"))
    current = F.when(F.col("conv_id") % 2 == 0, F.col("leaf")).alias("current_node")
    record = F.to_json(F.struct(F.col("conv_id").cast("string").alias("conversation_id"), current, "mapping"))
    exports = trees.select(F.from_json(record, H.TREE).alias("x")).select("x.*")
    return H.tree_turns(exports).select("session_id", "turn", "role", "text")


@query(SPOKEN.replace("role, text", "role, CASE role WHEN 'assistant' THEN text || chr(10) || chr(10) || 'more' ELSE text END AS text"))
def session_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of all conversations written as session lines: replies in two parts around a thought, a side chain beside each turn."""
    part = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    said = lambda content: F.struct("role", F.concat(F.lit("m"), "pos").alias("id"), content.alias("content"))
    session = F.col("conv_id").cast("string").alias("sessionId")
    line = lambda message, aside=False: F.to_json(F.struct(F.col("role").alias("type"), session, F.lit(aside).alias("isSidechain"), message.alias("message")))
    first = F.when(F.col("role") == "assistant", line(said(F.array(part("thinking", F.lit("hm")), part("text", F.col("text")))))).otherwise(line(said(F.col("text"))))
    second = F.when(F.col("role") == "assistant", line(said(F.array(part("text", F.lit("more"))))))
    lines = conversations(spark, sf_dir).select("pos", F.posexplode(F.array(first, second, line(said(F.lit("aside")), True))).alias("i", "j")).where("j IS NOT NULL")
    records = lines.select((F.col("pos") * 3 + F.col("i")).alias("line"), F.from_json("j", H.SESSION).alias("x")).select("line", "x.*")
    return H.session_turns(records).select("session_id", "turn", "role", "text")


@query("""SELECT 'customers/' || c_custkey AS src, n_name AS target, 'nations/' || n_nationkey AS dst FROM customer JOIN nation ON n_nationkey = c_nationkey
UNION ALL SELECT 'customers/' || a.c_custkey, 'customers/' || (a.c_custkey + 1), CASE WHEN b.c_custkey IS NOT NULL THEN 'customers/' || b.c_custkey END FROM customer a LEFT JOIN customer b ON b.c_custkey = a.c_custkey + 1
UNION ALL SELECT 'customers/' || c_custkey, 'Nobody ' || c_custkey, NULL FROM customer""")
def wikilink_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wikilinks of one page a customer, resolved by title, by slug with an anchor, or not at all."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    body = written("In [[%s]], before [[customers/%s#top|the next]] and [[Nobody %s]], not `[[code]]`.", "n_name", F.col("c_custkey") + 1, "c_custkey")
    people = c.join(n, F.col("n_nationkey") == F.col("c_nationkey")).select(F.concat(F.lit("customers/"), "c_custkey").alias("slug"), F.col("c_name").alias("title"), body.alias("body"))
    pages = people.unionAll(n.select(F.concat(F.lit("nations/"), "n_nationkey"), "n_name", F.lit(None).cast("string")))
    return L.resolved_links(L.page_wikilinks(pages), pages)


VERBS = ("co-founded", "invested in", "is a technical advisor to", "works at", "met")


@query("""WITH c AS (SELECT 'people/' || c_custkey AS src, c_custkey AS k, c_nationkey AS n FROM customer),
kinds AS (SELECT *, (['founded', 'invested_in', 'advises', 'works_at', NULL])[k % 5 + 1] AS verb, CASE WHEN k % 7 = 6 THEN NULL WHEN k % 3 = 1 THEN 'invested_in' WHEN k % 5 = 2 THEN 'advises' WHEN k % 3 = 0 THEN 'works_at' END AS role FROM c)
SELECT src, 'companies/' || n AS target, CASE WHEN k % 7 = 6 THEN 'mentions' ELSE coalesce(verb, role, 'mentions') END AS type FROM kinds
UNION ALL SELECT src, 'companies/' || n || '-labs', coalesce(role, 'mentions') FROM kinds
UNION ALL SELECT src, 'companies/listed', CASE WHEN k % 7 <> 6 AND k % 2 = 0 THEN 'founded' ELSE 'mentions' END FROM kinds
UNION ALL SELECT src, 'people/' || (k + 1), 'mentions' FROM kinds""")
def verb_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of a page a customer, typed by the words around any of their mentions or by the role that the page states; the name of one
    target begins another's, a list alone lends no role, and media pages only mention."""
    k = F.col("c_custkey")
    verb = F.element_at(F.array(*map(F.lit, VERBS)), (k % 5 + 1).cast("int"))
    role = F.element_at(F.array(*map(F.lit, ("is on the team at large", "is a venture partner", "likes tea"))), (k % 3 + 1).cast("int"))
    far = F.lit("x" * 300)
    body = written("She %s. [[companies/%s-labs]] is near [[people/%s]] and [[companies/%s]]. %s\nIn May she %s [[companies/%s#team|the firm]]. %s\n## Timeline\n- 2024: %s [[companies/listed]]\n### 2023\n- [[companies/listed]] `[[companies/code]]`",
                   role, "c_nationkey", k + 1, "c_nationkey", far, verb, "c_nationkey", far, F.when(k % 2 == 0, "founded").otherwise("saw"))
    pages = table(spark, sf_dir, "customer").select(F.concat(F.lit("people/"), k).alias("slug"), F.when(k % 7 == 6, "media").otherwise("person").alias("type"), body.alias("body"))
    return LT.typed_links(pages)


@query("""WITH c AS (SELECT 'meetings/' || conv_id AS src, conv_id AS k, count(*) AS n FROM conversations GROUP BY conv_id)
SELECT src, 'people/' || (k * 100 + i) AS target, 'attended' AS type FROM c, unnest(range(n)) t(i)
UNION ALL SELECT src, 'host' || k, 'attended' FROM c UNION ALL SELECT src, 'people/late' || k, 'mentions' FROM c UNION ALL SELECT src, 'companies/' || k, 'mentions' FROM c
UNION ALL SELECT src, 'people/todo' || k, 'mentions' FROM c UNION ALL SELECT src, 'people/twice' || k, 'attended' FROM c""")
def meeting_attendance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who attended: a meeting page a conversation with a section of those present, a line that names more, asides, code and tasks."""
    c = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("k")).agg(F.count("*").alias("n"))
    listed = F.array_join(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.concat(F.lit("- [[people/"), F.col("k") * 100 + i, F.lit("]]"))), "\n")
    body = written("# Sync\nRecap by [[people/twice%s]].\n## Attendees\n%s\n- [[people/twice%s|T]] (host), [[people/late%s]]\n- [[companies/%s]]\n#### Remote\n```\n## Attendees\n- [[people/code%s]]\n```\n## Tasks\n- [[people/todo%s]]\n**Participants:** [[host%s]] & [[companies/%s]], then [[people/late%s]]",
                   "k", listed, *["k"] * 8)
    return LT.typed_links(c.select(F.concat(F.lit("meetings/"), "k").alias("slug"), F.lit("meeting").alias("type"), body.alias("body")))


@query("""SELECT DISTINCT * FROM (SELECT 'c' || o_custkey AS src, 'o' || o_orderkey AS dst, 'attended' AS type, 0.8::DOUBLE AS confidence FROM orders UNION ALL SELECT 'o' || o_orderkey, 'day ' || strftime(o_orderdate, '%Y-%m-%d'), 'related_to', 0.8 FROM orders
UNION ALL SELECT 'c' || c_custkey, lower(c_mktsegment), 'works_at', 0.8 FROM customer UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'works_at', 0.8 FROM customer)""")
def field_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed links from fields of meetings (one an order) and persons (one a customer); a field that the type does not have gives none."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    field = lambda slug, kind, name, value: [slug.alias("slug"), F.lit(kind).alias("type"), F.lit(name).alias("field"), value.alias("value")]
    meeting, person = F.concat(F.lit("o"), "o_orderkey"), F.concat(F.lit("c"), "c_custkey")
    fields = o.select(*field(meeting, "meeting", "attendees", F.concat(F.lit(" C"), "o_custkey")))
    fields = fields.unionAll(o.select(*field(meeting, "meeting", "related", F.concat(F.lit("Day "), F.date_format("o_orderdate", "yyyy-MM-dd")))))
    fields = fields.unionAll(o.select(*field(meeting, "meeting", "companies", F.lit("none"))))
    return L.field_links(fields.unionAll(c.select(*field(person, "person", "companies", written("%s, N%s,n%s", "c_mktsegment", "c_nationkey", "c_nationkey")))))


@query("""SELECT 'who' || n_nationkey AS query_id, c_name AS node FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_custkey % 2 = 0 UNION ALL SELECT 'made' || n_nationkey, c_name FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_custkey % 2 = 1
UNION ALL SELECT 'where' || c_custkey, 'house of ' || c_nationkey FROM customer WHERE c_custkey % 2 = 0""")
def relational_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions on every nation's house and every customer, answered along typed links; other talk is no question."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    edges = c.select(F.col("c_name").alias("src"), F.concat(F.lit("house of "), "c_nationkey").alias("dst"), F.when(F.col("c_custkey") % 2 == 0, "works_at").otherwise("founded").alias("type"))
    asked = lambda rows, key, name, text, *of: rows.select(F.concat(F.lit(name), key).alias("query_id"), written(text, *of).alias("query"))
    questions = asked(n, "n_nationkey", "who", "Who works at the House of %s?", "n_nationkey").unionAll(asked(n, "n_nationkey", "made", "who founded House of %s", "n_nationkey"))
    questions = questions.unionAll(asked(c, "c_custkey", "where", "Where does %s work", "c_name")).unionAll(asked(c, "c_custkey", "talk", "nice weather, %s", "c_name"))
    return L.relational_answers(L.relational_questions(questions), edges)


@query("SELECT c_mktsegment AS node, 2 AS depth FROM customer WHERE c_nationkey = 0 INTERSECT SELECT c_mktsegment, 2 FROM customer WHERE c_nationkey = 1")
def relational_connects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market segments that connect two nations through all customers."""
    edges = table(spark, sf_dir, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("src"), F.col("c_mktsegment").alias("dst")).distinct()
    return L.between(edges, "n0", "n1", 1)


@query("""SELECT c_custkey AS id, 'n' || c_nationkey || '/c' || c_custkey || '.py' AS path, 'd' || c_custkey AS document_id FROM customer
UNION ALL SELECT -1 - c_custkey, 'c' || c_custkey || '.py', 'd' || c_custkey FROM customer UNION ALL SELECT -1 - c_custkey, 'c' || c_custkey || '.py', 'x' || c_custkey FROM customer WHERE c_custkey % 10 = 0""")
def file_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suffix join of references, by long and short path, with one file a customer; half a name is no reference."""
    c = table(spark, sf_dir, "customer")
    docs = c.select(F.concat(F.lit("d"), "c_custkey").alias("document_id"), written("/src/n%s/c%s.py", "c_nationkey", "c_custkey").alias("source_path"))
    docs = docs.unionAll(c.where("c_custkey % 10 = 0").select(F.concat(F.lit("x"), "c_custkey"), written("/x/c%s.py", "c_custkey")))
    refs = c.select(F.col("c_custkey").alias("id"), written("n%s/c%s.py", "c_nationkey", "c_custkey").alias("path")).unionAll(c.select(-1 - F.col("c_custkey"), written("c%s.py", "c_custkey")))
    return L.file_references(refs.unionAll(c.select("c_custkey", written("%s.py", "c_custkey"))), docs)


@query("""SELECT CASE c_custkey % 3 WHEN 0 THEN 'alias ' || c_custkey WHEN 1 THEN lower(c_name) ELSE 'the c ' || c_custkey END AS mention, 'people/the-c-' || c_custkey AS slug, (CASE c_custkey % 3 WHEN 0 THEN 0.9 WHEN 1 THEN 0.8 ELSE 0.6 END)::DOUBLE AS confidence FROM customer""")
def slug_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions of all customers resolved by alias, title or slug tail; unknown ones by none."""
    c = table(spark, sf_dir, "customer").select("*", F.concat(F.lit("people/the-c-"), "c_custkey").alias("slug"))
    k = F.col("c_custkey") % 3
    mention = F.when(k == 0, written("Alias %s ", "c_custkey")).when(k == 1, F.col("c_name")).otherwise(written("the C %s", "c_custkey"))
    mentions = c.select(mention.alias("mention")).unionAll(c.select(written("nobody %s", "c_custkey")))
    return L.pointers(mentions, c.select(written("alias %s", "c_custkey").alias("alias"), "slug"), c.select("slug", F.col("c_name").alias("title")))


@query("""WITH c AS (SELECT c_name AS slug, * FROM customer)
SELECT slug, 1 AS row_num, 'likes ' || c_mktsegment AS claim, 'preference' AS kind, 0.9::DOUBLE AS confidence, DATE '2024-01-01' + CAST(c_custkey % 300 AS INTEGER) AS valid_from, NULL AS source, true AS active FROM c WHERE c_custkey % 2 = 0
UNION ALL SELECT slug, 2, 'old ' || c_custkey, 'fact', 1.0, NULL, NULL, false FROM c WHERE c_custkey % 2 = 0 UNION ALL SELECT slug, CAST(c_custkey + 1 AS INTEGER), 'plain', 'fact', 0.5, NULL, c_mktsegment, true FROM c WHERE c_custkey % 2 = 1""")
def fact_fence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fact tables of one page a customer, with a header or in the old order; odd kinds, confidences and dates are put right."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("c_custkey") % 300).cast("int"))
    new = written(f"# P\n{N.BEGIN}\n| # | claim | kind | confidence | valid_from |\n|---|---|---|---|---|\n| 1 | likes %s | preference | 0.9 | %s |\n| 2 | ~~old %s~~ | odd | 7 | bad |\n| 3 | | fact | 1 | |\n{N.END}\n| 9 | outside | fact | 1 | |",
                  "c_mktsegment", F.date_format(day, "yyyy-MM-dd"), "c_custkey")
    old = written(f"{N.BEGIN}\n| %s | plain | 0.5 | %s |\n{N.END}", F.col("c_custkey") + 1, "c_mktsegment")
    pages = table(spark, sf_dir, "customer").select(F.col("c_name").alias("slug"), F.when(F.col("c_custkey") % 2 == 0, new).otherwise(old).alias("body"))
    return N.fact_rows(pages).drop("valid_until")


@query("""WITH r AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, CASE WHEN o_orderstatus = 'F' THEN '~~order ' || o_orderkey || '~~' ELSE 'order ' || o_orderkey END AS claim FROM orders)
SELECT o_custkey AS slug, '<!-- facts:begin -->' || chr(10) || '| # | claim | kind | confidence |' || chr(10) || '|---|---|---|---|' || chr(10) || string_agg('| ' || n || ' | ' || claim || ' | event | 0.5 |', chr(10) ORDER BY n) || chr(10) || '<!-- facts:end -->' AS fence FROM r GROUP BY 1""")
def fact_fence_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders rendered as one fact table a customer."""
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    facts = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("slug"), n.alias("row_num"), written("order %s", "o_orderkey").alias("claim"), F.lit("event").alias("kind"), F.lit(0.5).alias("confidence"), (F.col("o_orderstatus") != "F").alias("active"))
    return N.rendered_facts(facts)


@query("""SELECT o_custkey AS slug, CASE WHEN o_orderkey % 2 = 0 THEN 'bullet' ELSE 'citation' END AS kind, CAST(o_orderdate AS DATE) AS day, 'order ' || o_orderkey AS event, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'Source: ' || o_orderpriority END AS detail FROM orders
UNION ALL SELECT o_custkey, 'header', max(CAST(o_orderdate AS DATE)), 'Latest', '' FROM orders GROUP BY 1""")
def body_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated bullets, headings and citations of one page a customer; bullets outside the timeline and days that do not exist give none."""
    day, even = F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderkey") % 2 == 0
    lines = lambda c: F.array_join(F.sort_array(F.collect_list(c)), "\n")
    bullet, again, cited = written("- **%s** — order %s", day, "o_orderkey"), written("- %s: order %s", day, "o_orderkey"), written("order %s [Source: %s, %s]", "o_orderkey", "o_orderpriority", day)
    parts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("slug")).agg(lines(F.when(even, F.concat(bullet, F.lit("\n"), again))).alias("b"), lines(F.when(~even, cited)).alias("c"), F.max(day).alias("d"))
    return N.body_timeline(parts.select("slug", written("# P\n- 2024-01-01: before\n## Timeline\n%s\n- 2024-02-30: no such day\n### %s Latest\n## Notes\n%s\n- 2024-05-01: after", "b", "d", "c").alias("body")))


MENTIONS_SQL = """
WITH c AS (SELECT c_custkey AS id, c_nationkey AS k, (c_nationkey + 1) % 25 AS l FROM customer),
m AS (SELECT id, 1 AS "at", 'house ' || k || ' east' AS phrase, 'e' || k AS slug FROM c
 UNION ALL SELECT id, 7, 'house ' || l, 'h' || l FROM c
 UNION ALL SELECT id, 18, 'house ' || k || ' of the north sea', 'n' || k FROM c
 UNION ALL SELECT id, 28, 'o''neil & co.', 'oneil' FROM c WHERE k % 2 = 0
 UNION ALL SELECT id, 36, 'house ' || k, 'h' || k FROM c)
"""


def nation_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of every nation, some within others, one overlapping another, and one with signs."""
    n = table(spark, sf_dir, "nation")
    named = lambda phrase, slug: n.select(written(phrase, "n_nationkey").alias("phrase"), F.concat(F.lit(slug), "n_nationkey").alias("slug"))
    names = named("house %s", "h").unionAll(named("house %s east", "e")).unionAll(named("house %s of the north sea", "n")).unionAll(named("%s east met", "x"))
    return names.unionAll(spark.createDataFrame([("o'neil & co.", "oneil")], "phrase string, slug string"))


def customer_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A note for each customer with names that overlap, in code, in a link, in small letters, across lines, with signs, and cut by letters."""
    c, other = texts(spark, sf_dir, "customer", "c_custkey", "c_nationkey"), (F.col("c_nationkey") + 1) % 25
    signs = F.when(F.col("c_nationkey") % 2 == 0, "  O'Neil & Co. came;").otherwise(" O'Neil & Co.s;")
    opening = written("The House %s East met then in House %s. `House 3 East` and [[House 4]], a house 5 of cards; ", "c_nationkey", other)
    return c.select(F.col("c_custkey").alias("id"), F.concat(opening, written("House\n%s of the  North Sea was Warehouse %s?", "c_nationkey", "c_nationkey"), signs, written(" HOUSE %s", "c_nationkey")).alias("text"))


@query(MENTIONS_SQL + "SELECT * FROM m")
def gazetteer_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leftmost-longest matches of all names in a note a customer, names of six words and with signs among them."""
    return M.mentions(customer_notes(spark, sf_dir), nation_names(spark, sf_dir))


@query(MENTIONS_SQL + """SELECT 'page' || id AS src, slug AS dst, min("at") AS "at" FROM m GROUP BY 1, 2""")
def mention_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links from each customer's page to the pages that its note names, by first mention."""
    return M.mention_links(customer_notes(spark, sf_dir).withColumn("id", F.concat(F.lit("page"), "id")), M.usable_names(nation_names(spark, sf_dir)))


@query("""WITH p AS (SELECT DISTINCT 'parts/' || replace(p_name, ' ', '-') AS slug, replace(p_name, ' ', '-') AS tail FROM part),
n AS (SELECT slug AS name FROM p UNION SELECT 'The ' || tail FROM p UNION SELECT tail FROM p UNION SELECT left(tail, length(tail) - 1) FROM p UNION SELECT tail || 's' FROM p UNION SELECT 'z' || substr(tail, 2) FROM p),
g AS (SELECT name, tail, slug, list_distinct(flatten(list_transform(string_split(name, '-'), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))) AS a, list_distinct(flatten(list_transform(string_split(tail, '-'), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))) AS b FROM n, p WHERE NOT contains(name, '/') AND NOT contains(name, ' ')),
s AS (SELECT name, slug, len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) AS sim FROM g),
r AS (SELECT name, slug, sim, row_number() OVER w AS i, coalesce(lead(sim) OVER w, 0) AS nxt FROM s WINDOW w AS (PARTITION BY name ORDER BY sim DESC, slug)),
x AS (SELECT name, slug, 1 AS stage FROM n JOIN p ON slug = name UNION ALL SELECT name, slug, 2 FROM n JOIN p ON name = 'The ' || tail UNION ALL SELECT name, slug, 3 FROM n JOIN p ON name = tail
 UNION ALL SELECT name, min(slug), 4 FROM n JOIN p ON starts_with(tail, name) GROUP BY name HAVING count(*) = 1 UNION ALL SELECT name, slug, 5 FROM r WHERE i = 1 AND sim >= 0.7 AND sim - nxt >= 0.1)
SELECT name, min_by(slug, stage) AS slug, (['exact', 'alias', 'tail', 'prefix', 'trigram'])[min(stage)] AS stage FROM x GROUP BY name""")
def slug_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of all parts, right, by alias, as tails, cut short, too long or with another first letter, resolved by a cascade of rules."""
    pages = table(spark, sf_dir, "part").select(F.regexp_replace("p_name", " ", "-").alias("tail")).distinct().select("tail", F.concat(F.lit("parts/"), "tail").alias("slug"))
    t = F.col("tail")
    forms = F.array("slug", F.concat(F.lit("The "), t), t, F.substring(t, F.lit(1), F.length(t) - 1), F.concat(t, F.lit("s")), F.concat(F.lit("z"), F.substring(t, 2, 1000)))
    return G.canonical_slugs(pages.select(F.explode(forms).alias("name")), pages, pages.select(F.concat(F.lit("The "), "tail").alias("alias"), "slug"))


@query("""WITH RECURSIVE e AS (SELECT p_partkey AS a, p_partkey // 2 AS b FROM part WHERE p_partkey > 0), u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
w AS (SELECT 8::BIGINT AS k, 0 AS hop UNION SELECT u.b, w.hop + 1 FROM w JOIN u ON u.a = w.k WHERE w.hop < 2)
SELECT 'k' || k AS id, round(1.0 / (1 + min(hop)), 6)::DOUBLE AS score, min(hop) AS hop FROM w GROUP BY k""")
def structural_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Callers and callees of an anchor chunk, two hops in a call tree over all parts."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    name = lambda c, prefix: F.concat(F.lit(prefix), c)
    chunks = p.select(name(F.col("k"), "k").alias("id"), name(F.col("k"), "m.").alias("symbol"), name(F.col("k"), "").alias("bare_symbol"))
    callee = F.floor(F.col("k") / 2)
    edges = p.where("k > 0").select(name(F.col("k"), "m.").alias("caller"), name(callee, "m.").alias("callee"), name(F.col("k"), "k").alias("caller_chunk"))
    anchors = chunks.where("id = 'k8'").select("id", F.lit(1.0).alias("score"), "symbol")
    return U.structural_expansion(anchors, edges, chunks).withColumn("score", F.round("score", 6))


@query("""WITH s AS (SELECT event_type AS metric, round(avg(value) FILTER (event_id % 2 = 0), 6) AS before, round(avg(value) FILTER (event_id % 2 = 1), 6) AS now FROM events GROUP BY 1) SELECT metric, before, now, before - now <= 0.05 AS passes FROM s""")
def evaluation_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of all events by type that may not drop by more than a limit from even to odd ones."""
    e = table(spark, sf_dir, "events")
    mean = lambda odd: e.where(F.col("event_id") % 2 == odd).groupBy(F.col("event_type").alias("metric")).agg(F.round(F.avg("value"), 6).alias("value"))
    return U.gate(mean(1), mean(0), 0.05)
