"""Operators on hand-written notes, logs and graphs, each against the rows they must give."""

import json

import duckdb
import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import chunking as C
from tessera.operators import fences as N
from tessera.operators import graph as G
from tessera.operators import links as L
from tessera.operators import linktypes as LT
from tessera.operators import mentions as M
from tessera.operators import upkeep as U
from tessera.sources import files as S
from tessera.sources import transcripts as H
from test_queries import rows

CASES = {}


def query(sql):
    def register(f):
        CASES[f.__name__] = (f, sql)
        return f

    return register


MARKDOWN = "# One\n\nSee [[Page A|a]] and [[Page B]] #Tag1 on 2024-02-03 and 3024-01-01.\n\n```python\ndef f():\n    return g()\n```\n\n## Two\n\n[x](../notes/b.md#h) `[[no]]` src/app.py:12 mail a.b@c.org key https://u:p@h.org/x"


@query("""SELECT ['Page A', 'Page B'] AS wikilinks, ['tag1'] AS hashtags, ['2024-02-03'] AS dates, ['notes/b'] AS links, 'src/app.py' AS ref_path, 12 AS ref_line, 'def f():' || chr(10) || '    return g()' || chr(10) AS code, true AS redacted""")
def markdown_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, tags, dates, code and references of a note."""
    d, t = spark.createDataFrame([(MARKDOWN,)], "t string"), F.col("t")
    return d.select(X.wikilinks(X.strip_code(t)).alias("wikilinks"), X.hashtags(t).alias("hashtags"), X.iso_dates(t).alias("dates"), X.markdown_links(t).alias("links"), X.code_refs(t)[0]["path"].alias("ref_path"),
                    X.code_refs(t)[0]["line"].alias("ref_line"), C.fenced_code(t)[0]["code"].alias("code"), X.redact_url_credentials(t).contains("https://***:***@h.org/x").alias("redacted"))


@query("SELECT * FROM (VALUES ('a.py','A','class',1,4,'g'), ('a.py','m','method',3,4,'g'), ('a.py','top','function',6,7,'A,A().m')) t(path, name, kind, start_line, end_line, calls)")
def code_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of Python source with their calls."""
    source = "class A:\n    x = 1\n    def m(self):\n        return g()\n\ndef top():\n    return A().m()"
    d = spark.createDataFrame([("a.py", source), ("b.py", "not ( python")], "path string, text string")
    return C.code_symbols(d).select("path", "name", "kind", "start_line", "end_line", F.array_join("calls", ",").alias("calls"))


@query("SELECT * FROM (VALUES (1, 'Title', 'a,b', 'Body' || chr(10)), (2, NULL, NULL, 'no block')) t(id, title, tags, body)")
def frontmatter_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frontmatter scalars and lists."""
    d = spark.createDataFrame([(1, '---\ntitle: "Title"\ntags:\n- a\n- b\n---\nBody\n'), (2, "no block")], "id int, text string").withColumn("f", S.frontmatter("text"))
    get = lambda k: F.array_join(F.try_element_at("f.fields", F.lit(k)), ",")
    return d.select("id", get("title").alias("title"), get("tags").alias("tags"), F.col("f.body").alias("body"))


@query("""SELECT * FROM (VALUES (1,1,'Alice','2024-03-15T18:37:00Z','hi' || chr(10) || 'more'), (1,2,'Bob','1970-01-01T00:00:00Z','yo'), (1,3,'carl','1970-01-01T00:00:00Z','irc'), (1,4,'Dora','1970-01-01T09:05:00Z','x')) t(id, n, speaker, "at", text)""")
def chat_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of a chat log in four line grammars with continuation lines."""
    log = "lost line\n[2024-03-15, 18:37] Alice: hi\n  more\nBob: yo\n<carl> irc\n[9:05] Dora: x"
    return H.chat_log_messages(spark.createDataFrame([(1, log)], "id int, text string"))


@query("SELECT * FROM (VALUES ('c1', 0, 'user', 'hello'), ('c1', 1, 'assistant', 'new answer')) t(session_id, turn, role, text)")
def tree_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current branch of a tree export."""
    node = lambda parent, children, role, text, t: {"parent": parent, "children": children, "message": {"author": {"role": role}, "create_time": t, "content": {"parts": [text]}}}
    tree = {"conversation_id": "c1", "current_node": "d", "mapping": {"r": {"parent": None, "children": ["a"]}, "a": node("r", ["b", "d"], "user", "hello", 1.0), "b": node("a", [], "assistant", "old answer", 2.0), "d": node("a", [], "assistant", "new answer", 3.0)}}
    d = spark.createDataFrame([(json.dumps(tree),)], "j string").select(F.from_json("j", H.TREE).alias("x")).select("x.*")
    return H.tree_turns(d).select("session_id", "turn", "role", "text")


@query("SELECT * FROM (VALUES ('s1', 0, 'user', 'ask'), ('s1', 1, 'assistant', 'part one' || chr(10) || chr(10) || 'part two')) t(session_id, turn, role, text)")
def session_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speech of a session log: side chains dropped, parts of a reply joined."""
    rows = [
        '{"type":"user","sessionId":"s1","uuid":"1","message":{"role":"user","content":"ask"}}',
        '{"type":"assistant","sessionId":"s1","uuid":"2","message":{"role":"assistant","id":"m","content":[{"type":"thinking","text":"hm"},{"type":"text","text":"part one"}]}}',
        '{"type":"assistant","sessionId":"s1","uuid":"3","message":{"role":"assistant","id":"m","content":[{"type":"text","text":"part two"}]}}',
        '{"type":"assistant","sessionId":"s1","isSidechain":true,"uuid":"4","message":{"role":"assistant","id":"n","content":"aside"}}',
    ]
    d = spark.createDataFrame(list(enumerate(rows)), "line int, j string").select("line", F.from_json("j", H.SESSION).alias("x")).select("line", "x.*")
    return H.session_turns(d).select("session_id", "turn", "role", "text")


NOTES = [
    ("people/ada", "person", "Ada", "Ada founded [[Acme]] with [[Bob]]. Later Ada advised [[Initech|them]] `[[code]]`."),
    ("people/bob", "person", "Bob", "Bob works at [[companies/acme#team]] and met [[Nobody]]."),
    ("companies/acme", "company", "Acme", "No links."),
    ("companies/initech", "company", "Initech", None),
]


def notes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(NOTES, "slug string, type string, title string, body string")


@query("SELECT * FROM (VALUES ('people/ada','Acme','companies/acme'), ('people/ada','Bob','people/bob'), ('people/ada','Initech','companies/initech'), ('people/bob','companies/acme','companies/acme'), ('people/bob','Nobody',NULL)) t(src, target, dst)")
def wikilink_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wikilinks of pages, resolved by slug or title."""
    return L.resolved_links(L.page_wikilinks(notes(spark)), notes(spark))


@query("SELECT * FROM (VALUES ('people/ada','Acme','founded'), ('people/ada','Bob','founded'), ('people/ada','Initech','founded'), ('people/bob','companies/acme','works_at'), ('people/bob','Nobody','works_at')) t(src, target, type)")
def verb_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wikilinks typed by the words around them."""
    return LT.typed_links(notes(spark))


@query("SELECT * FROM (VALUES ('ada','acme','works_at',0.8::DOUBLE), ('ada','initech','works_at',0.8), ('bob','m1','attended',0.8), ('ada','x','related_to',0.8)) t(src, dst, type, confidence)")
def field_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed links from page fields."""
    rows = [("ada", "person", "companies", "Acme, Initech,acme"), ("m1", "meeting", "attendees", "bob"), ("ada", "person", "related", "x"), ("m1", "meeting", "companies", "no")]
    return L.field_links(spark.createDataFrame(rows, "slug string, type string, field string, value string"))


@query("SELECT * FROM (VALUES (1,'bob'), (2,'acme'), (4,'ada')) t(query_id, node)")
def relational_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions about relations answered from the graph."""
    q = spark.createDataFrame([(1, "Who works at Acme?"), (2, "Where does Bob work"), (3, "nice weather"), (4, "who founded the Acme")], "query_id int, query string")
    e = spark.createDataFrame([("bob", "acme", "works_at"), ("ada", "acme", "founded")], "src string, dst string, type string")
    return L.relational_answers(L.relational_questions(q), e)


@query("SELECT 'b' AS node, 2 AS depth")
def relational_connects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that connect two others."""
    e = spark.createDataFrame([("a", "b"), ("c", "b"), ("c", "d")], "src string, dst string")
    return L.between(e, "a", "c", 1)


@query("SELECT * FROM (VALUES (1,'core/app.py','d1'), (2,'app.py','d1'), (2,'app.py','d2')) t(id, path, document_id)")
def file_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suffix join of file references."""
    refs = spark.createDataFrame([(1, "core/app.py"), (2, "app.py"), (3, "pp.py")], "id int, path string")
    docs = spark.createDataFrame([("d1", "/src/core/app.py"), ("d2", "/x/app.py")], "document_id string, source_path string")
    return L.file_references(refs, docs)


@query("SELECT * FROM (VALUES ('countess','people/ada',0.9::DOUBLE), ('bob','people/bob',0.8), ('acme corp','companies/acme-corp',0.6)) t(mention, slug, confidence)")
def slug_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions resolved by alias, title or slug tail."""
    pages = spark.createDataFrame([("people/ada", "Ada"), ("people/bob", "Bob"), ("companies/acme-corp", "The Acme")], "slug string, title string")
    aliases = spark.createDataFrame([("Countess", "people/ada")], "alias string, slug string")
    return L.pointers(spark.createDataFrame([("Countess ",), ("bob",), ("acme corp",), ("zz",)], "mention string"), aliases, pages)


FENCE = "# P\n<!-- facts:begin -->\n| # | claim | kind | confidence | valid_from |\n|---|---|---|---|---|\n| 1 | likes tea | preference | 0.9 | 2024-01-02 |\n| 2 | ~~old~~ | odd | 7 | bad |\n| 3 | | fact | 1 | |\n<!-- facts:end -->\n| 9 | outside | fact | 1 | |"


OLD_FENCE = "<!-- facts:begin -->\n| 1 | plain | 0.5 | src |\n<!-- facts:end -->"


@query("SELECT * FROM (VALUES ('p',1,'likes tea','preference',0.9::DOUBLE,DATE '2024-01-02',NULL,true), ('p',2,'old','fact',1.0,NULL,NULL,false), ('q',1,'plain','fact',0.5,NULL,'src',true)) t(slug, row_num, claim, kind, confidence, valid_from, source, active)")
def fact_fence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fact tables of pages, with a header or in the old order."""
    return N.fact_rows(spark.createDataFrame([("p", FENCE), ("q", OLD_FENCE), ("r", "none")], "slug string, body string")).drop("valid_until")


@query("SELECT 'p' AS slug, '<!-- facts:begin -->' || chr(10) || '| # | claim | kind | confidence |' || chr(10) || '|---|---|---|---|' || chr(10) || '| 1 | a | fact | 0.5 |' || chr(10) || '| 2 | ~~b~~ | event | 1.0 |' || chr(10) || '<!-- facts:end -->' AS fence")
def fact_fence_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts rendered as a table."""
    return N.rendered_facts(spark.createDataFrame([("p", 2, "b", "event", 1.0, False), ("p", 1, "a", "fact", 0.5, True)], "slug string, row_num int, claim string, kind string, confidence double, active boolean"))


BODY = "# P\n- 2024-01-01: before\n## Timeline\n- **2024-01-02** — met Bob\n- 2024-02-30: no such day\n### 2024-03-01 Launch\n- 2024-01-02: met Bob\n## Notes\nShipped it [Source: mail, 2024-04-01]\n- 2024-05-01: after"


@query("SELECT * FROM (VALUES ('p','bullet',DATE '2024-01-02','met Bob',''), ('p','header',DATE '2024-03-01','Launch',''), ('p','citation',DATE '2024-04-01','Shipped it','Source: mail')) t(slug, kind, day, event, detail)")
def body_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated bullets, headings and citations of a page."""
    return N.body_timeline(spark.createDataFrame([("p", BODY)], "slug string, body string"))


@query("SELECT * FROM (VALUES (1, 'united states', 'us', 1), (1, 'france', 'fr', 4), (2, 'united kingdom', 'uk', 0)) t(id, phrase, slug, \"at\")")
def gazetteer_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest matches of page names in texts."""
    phrases = spark.createDataFrame([("united states", "us"), ("states", "st"), ("france", "fr"), ("united kingdom", "uk")], "phrase string, slug string")
    texts = spark.createDataFrame([(1, "The United States and France"), (2, "United Kingdom!"), (3, None)], "id int, text string")
    return M.mentions(texts, phrases)


@query("SELECT * FROM (VALUES ('k1',1.0::DOUBLE,0), ('k2',0.5,1), ('k3',0.5,1), ('k4',0.333333,2)) t(id, score, hop)")
def structural_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Callers and callees of anchor chunks, two hops."""
    chunks = spark.createDataFrame([("k1", "m.a", "a"), ("k2", "m.b", "b"), ("k3", "m.c", "c"), ("k4", "m.d", "d"), ("k5", "m.e", "e")], "id string, symbol string, bare_symbol string")
    edges = spark.createDataFrame([("m.b", "m.a", "k2"), ("m.a", "c", "k1"), ("m.c", "m.d", "k3"), ("m.d", "m.e", "k4")], "caller string, callee string, caller_chunk string")
    anchors = spark.createDataFrame([("k1", 1.0, "m.a")], "id string, score double, symbol string")
    return U.structural_expansion(anchors, edges, chunks).withColumn("score", F.round("score", 6))


@query("SELECT * FROM (VALUES ('mrr',0.8::DOUBLE,0.79::DOUBLE,true), ('ndcg',0.9,0.7,false)) t(metric, before, now, passes)")
def evaluation_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics that may not drop by more than a limit."""
    before = spark.createDataFrame([("mrr", 0.8), ("ndcg", 0.9)], "metric string, value double")
    return U.gate(spark.createDataFrame([("mrr", 0.79), ("ndcg", 0.7)], "metric string, value double"), before, 0.05)


@query("SELECT * FROM (VALUES ('people/ada-lovelace','people/ada-lovelace','exact'), ('countess','people/ada-lovelace','alias'), ('grace-hopper','people/grace-hopper','tail'), ('alan','people/alan-turing','prefix'), ('grace-hoper','people/grace-hopper','trigram'), ('nargaret-hamiltonian','people/margaret-hamiltonian','trigram')) t(name, slug, stage)")
def slug_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names resolved to pages by a cascade of rules."""
    pages = spark.createDataFrame([("people/ada-lovelace",), ("people/grace-hopper",), ("people/alan-turing",), ("people/margaret-hamiltonian",)], "slug string")
    aliases = spark.createDataFrame([("countess", "people/ada-lovelace")], "alias string, slug string")
    names = spark.createDataFrame([(n,) for n in ("people/ada-lovelace", "countess", "grace-hopper", "alan", "grace-hoper", "nargaret-hamiltonian", "nobody")], "name string")
    return G.canonical_slugs(names, pages, aliases)


@pytest.mark.parametrize("name", sorted(CASES))
def test_written_case(spark, name):
    f, sql = CASES[name]
    df = f(spark, "")
    cursor = duckdb.connect().execute(sql)
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, cursor.fetchall())
