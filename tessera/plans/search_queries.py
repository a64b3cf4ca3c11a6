"""Search arms, fusion, score stages and result shaping over the test tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import rank as R
from tessera.functions import text as X
from tessera.operators import fulltext as FT
from tessera.operators import querycache as QC
from tessera.operators import search as S
from tessera.operators.graph import reliable_checkpoint
from tessera.plans.registry import query, table, texts

NOW = "2024-02-01 00:00:00"


def longest_words(docs: DataFrame, n: int = 3) -> DataFrame:
    """(doc_id, longest): the ``n`` longest different words of each text of ``docs`` (doc_id, text), longest first, ties by spelling; no row for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, FT.SLICE_DOCS):
                batch = whole.slice(begin, FT.SLICE_DOCS)
                numbered = batch.column(1).flatten().dictionary_encode()
                words = numbered.dictionary
                order = pc.sort_indices(pa.table({"n": pc.negate(pc.utf8_length(words)), "w": words}), [("n", "ascending"), ("w", "ascending")]).to_numpy()
                place = np.empty(len(words), dtype=np.int64)
                place[order] = np.arange(len(words))
                sizes = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
                row, left, taken = np.repeat(np.arange(batch.num_rows), sizes), place[numbered.indices.to_numpy(zero_copy_only=False)], []
                for _ in range(n):  # the longest of each text, then of what is left
                    first = np.flatnonzero(np.diff(row, prepend=-1))
                    if not len(first):
                        break
                    best = np.minimum.reduceat(left, first)
                    taken.append((row[first], best))
                    more = left != np.repeat(best, np.diff(np.append(first, len(row))))
                    row, left = row[more], left[more]
                if taken:
                    of, best = (np.concatenate([t[i] for t in taken]) for i in (0, 1))
                    by_text = np.argsort(of, kind="stable")
                    at, first = np.unique(of[by_text], return_index=True)
                    longest = pa.ListArray.from_arrays(pa.array([*first, len(of)], pa.int32()), words.take(pa.array(order[best[by_text]])))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), longest], names=["doc_id", "longest"])

    return docs.select("doc_id", X.tokens(F.col("text"))).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, longest array<string>")


def keyword_queries(longest: DataFrame) -> DataFrame:
    """The stated block of queries, from ``longest_words``: for every document whose id is divisible by 20 its three longest words."""
    return longest.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.array_join("longest", " ").alias("query"))


def keyword_hits(docs: DataFrame, k: int, queries: DataFrame | None = None) -> DataFrame:
    """The ``k`` best documents for each query of the stated block; a document's first three words are of class A, its text of class B."""
    queries = keyword_queries(longest_words(docs.where("doc_id % 20 = 0"))) if queries is None else queries
    terms = reliable_checkpoint(FT.numbered_terms(queries))
    cut = docs.select("doc_id", X.tokens(F.col("text")).alias("words"))
    return FT.held_arm(FT.held_words(cut, "doc_id", {"A": F.slice("words", 1, 3), "B": F.col("words")}, terms), terms, k)


KEYWORD_SQL = r"""
WITH q AS (SELECT doc_id AS query_id, list_transform(list_sort(list_transform(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')), lambda w: {'n': -length(w), 'w': w})), lambda r: r.w)[1:3] AS query FROM documents WHERE doc_id % 20 = 0),
asked AS (SELECT query_id, unnest(query) AS term FROM q),
terms AS (SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY term) AS t, count(*) OVER (PARTITION BY query_id) AS n FROM asked),
w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS words FROM documents),
ix AS (SELECT doc_id AS id, unnest(range(1, len(words[1:3]) + 1)) AS pos, 1.0::DOUBLE AS inv, unnest(words[1:3]) AS term FROM w
  UNION ALL SELECT doc_id, unnest(range(len(words[1:3]) + 1, len(words[1:3]) + len(words) + 1)), 2.5, unnest(words) FROM w),
e AS (SELECT query_id, id, pos, t, n, row_number() OVER d AS i, sum(inv) OVER d AS upto, inv FROM ix JOIN terms USING (term) WINDOW d AS (PARTITION BY query_id, id ORDER BY pos)),
l AS (SELECT *, max(i) FILTER (t = 1) OVER d AS a, max(i) FILTER (t = 2) OVER d AS b, max(i) FILTER (t = 3) OVER d AS c FROM e WINDOW d AS (PARTITION BY query_id, id ORDER BY pos)),
f AS (SELECT *, CASE WHEN n = 1 THEN a WHEN n = 2 THEN CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN least(a, b) END WHEN a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL THEN least(a, b, c) END AS first FROM l),
covers AS (SELECT query_id, id, first, min(i) AS last, min(pos) AS q, min(upto) AS upto FROM f WHERE first IS NOT NULL GROUP BY 1, 2, 3),
s AS (SELECT v.query_id, v.id, sum((last - first + 1) / (v.upto - e.upto + e.inv) / (1 + q - e.pos - last + first)) AS score FROM covers v JOIN e ON e.query_id = v.query_id AND e.id = v.id AND e.i = first GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM s)
"""


@query(KEYWORD_SQL + "SELECT query_id, r.id, round(score, 6) AS score, rank, length(text) AS n_chars FROM r JOIN documents d ON d.doc_id = r.id WHERE rank <= 10")
def keyword_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All-terms lexical search for several queries, ranked by weighted cover density; texts are joined after the cut."""
    docs = texts(spark, sf_dir, "documents", "doc_id", "text")
    hits = keyword_hits(docs, 10)
    sizes = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.length("text").alias("n_chars"))
    return hits.join(sizes, "id").select("query_id", "id", F.round("score", 6).alias("score"), "rank", "n_chars")


VECTOR_SQL = """
WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], qv) AS score FROM embeddings, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)
"""


def vector_hits(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    queries = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return S.vector_arm(v.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), queries, k)


@query(VECTOR_SQL + "SELECT query_id, id, round(score, 5) AS score, rank FROM r WHERE rank <= 10")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact cosine top-k for a stated block of query vectors."""
    return vector_hits(spark, sf_dir, 10).select("query_id", "id", F.round("score", 5).alias("score"), "rank")


@query(VECTOR_SQL + """, label_arm AS (
    SELECT q.vec_id AS query_id, e.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY e.vec_id) AS rank
    FROM embeddings e JOIN (SELECT vec_id, label FROM embeddings WHERE vec_id % 20 = 0) q USING (label)),
arms AS (SELECT query_id, id, rank, 1.1 AS w FROM r WHERE rank <= 20 UNION ALL SELECT query_id, id, rank, 1.0 FROM label_arm WHERE rank <= 20),
f AS (SELECT query_id, id, sum(1 / (60 / w + rank)) AS score, count(*) AS n_arms FROM arms GROUP BY 1, 2)
SELECT query_id, id, round(score, 8) AS score, n_arms FROM f""")
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reciprocal rank fusion of a vector arm and a label arm with intent weights."""
    v = table(spark, sf_dir, "embeddings")
    arm = vector_hits(spark, sf_dir, 20).select("query_id", "id", "rank", F.lit(R.INTENT_WEIGHTS["topic"][0]).alias("weight"))
    own = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "label")
    first = S.top_k(v.select(F.col("vec_id").alias("id"), "label", F.lit(1.0).alias("score")), 20, by="label")  # equal for all queries of a label
    arms = arm.unionByName(own.join(first, "label").select("query_id", "id", "rank", F.lit(1.0).alias("weight")))
    return S.fuse(arms).select("query_id", "id", F.round("score", 8).alias("score"), "n_arms")


@query(VECTOR_SQL + """, b AS (SELECT query_id, id, rank, 1 / (60 + rank) AS s, score AS cosine FROM r WHERE rank <= 20)
SELECT query_id, id, round(CASE WHEN id % 4 = 0 THEN s ELSE 0.7 * s / max(s) OVER (PARTITION BY query_id) + 0.3 * cosine END, 5) AS score FROM b""")
def cosine_rescore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blend of normalised fusion score and cosine; every fourth id has no vector."""
    hits = vector_hits(spark, sf_dir, 20).select("query_id", "id", F.when(F.col("id") % 4 != 0, F.col("score")).alias("cosine"), R.rrf(F.col("rank")).alias("score"))
    return S.cosine_blend(hits).select("query_id", "id", F.round("score", 5).alias("score"))


PATHS = ["originals/", "writing/", "concepts/", "people/", "daily/", "chat/", "media/x/", "test/", "page://meetings/", "other/"]
KINDS = ["vault", "memory", "webhook", "code", "github", "mail", None]


def order_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as hits of ten queries with paths, kinds and ages."""
    o = table(spark, sf_dir, "orders")
    path = F.concat(F.element_at(F.array(*map(F.lit, PATHS)), (F.col("o_orderkey") % 10 + 1).cast("int")), F.col("o_orderkey").cast("string"))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("o_orderkey") % 7 + 1).cast("int"))
    return o.select((F.col("o_custkey") % 10).alias("query_id"), F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("document_id"), path.alias("path"), kind.alias("kind"),
                    F.col("o_orderdate").cast("timestamp").alias("updated_at"), (F.col("o_totalprice") / 100000).alias("score"), F.substring("o_orderpriority", 1, 1).alias("type"))


ORDERS_SQL = """
WITH h AS (SELECT o_custkey % 10 AS query_id, o_orderkey AS id, o_custkey AS document_id,
    (['originals/','writing/','concepts/','people/','daily/','chat/','media/x/','test/','page://meetings/','other/'])[o_orderkey % 10 + 1] || o_orderkey AS path,
    (['vault','memory','webhook','code','github','mail',NULL])[o_orderkey % 7 + 1] AS kind,
    o_orderdate AS updated_at, o_totalprice / 100000 AS score, substr(o_orderpriority, 1, 1) AS type FROM orders),
p AS (SELECT *, regexp_replace(path, '^page(-truth)?://', '') AS np,
      greatest(0, epoch_us(TIMESTAMP '2024-02-01') - epoch_us(updated_at)) / 86400000000.0 AS age FROM h)
"""


@query(ORDERS_SQL + """SELECT id,
 CASE WHEN starts_with(np,'originals/') THEN 1.5 WHEN starts_with(np,'writing/') THEN 1.4 WHEN starts_with(np,'concepts/') THEN 1.3 WHEN starts_with(np,'people/') THEN 1.2
      WHEN starts_with(np,'meetings/') THEN 1.1 WHEN starts_with(np,'daily/') THEN 0.8 WHEN starts_with(np,'media/x/') THEN 0.7 WHEN starts_with(np,'chat/') THEN 0.5 ELSE 1.0 END::DOUBLE AS curation,
 CASE WHEN kind IS NULL THEN 1.0 WHEN kind='vault' THEN 1.0 WHEN kind='memory' THEN 0.7 WHEN kind='webhook' THEN 0.5 WHEN kind='code' THEN 0.85 WHEN kind='github' THEN 0.75 ELSE 0.8 END::DOUBLE AS source_boost,
 starts_with(np,'test/') AS excluded FROM p""")
def curation_and_source_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path-prefix curation, source-kind boost and hard exclusion as CASE expressions."""
    h = order_hits(spark, sf_dir).withColumn("path", R.normalized_path(F.col("path")))
    return h.select("id", R.curation(F.col("path")).alias("curation"), R.source_boost(F.col("kind")).alias("source_boost"), R.excluded(F.col("path")).alias("excluded"))


HALF = "CASE WHEN starts_with(np,'originals/') THEN 180 WHEN starts_with(np,'writing/') THEN 365 WHEN starts_with(np,'people/') THEN 365 WHEN starts_with(np,'daily/') THEN 14 WHEN starts_with(np,'chat/') THEN 7 WHEN starts_with(np,'media/x/') THEN 7 WHEN starts_with(np,'meetings/') THEN 60 ELSE 120 END"
FLOOR = "CASE WHEN starts_with(np,'originals/') THEN 0.7 WHEN starts_with(np,'writing/') THEN 0.7 WHEN starts_with(np,'people/') THEN 0.8 WHEN starts_with(np,'daily/') THEN 0.4 WHEN starts_with(np,'chat/') THEN 0.4 WHEN starts_with(np,'media/x/') THEN 0.4 WHEN starts_with(np,'meetings/') THEN 0.5 ELSE 0.6 END"
BHALF = "CASE WHEN starts_with(np,'originals/') THEN 180 WHEN starts_with(np,'writing/') THEN 365 WHEN starts_with(np,'people/') THEN 365 WHEN starts_with(np,'daily/') THEN 14 WHEN starts_with(np,'chat/') THEN 7 WHEN starts_with(np,'media/x/') THEN 7 WHEN starts_with(np,'meetings/') THEN 60 ELSE 90 END"
COEF = "CASE WHEN starts_with(np,'originals/') THEN 0.5 WHEN starts_with(np,'writing/') THEN 0.4 WHEN starts_with(np,'people/') THEN 0.3 WHEN starts_with(np,'daily/') THEN 1.5 WHEN starts_with(np,'chat/') THEN 1.0 WHEN starts_with(np,'media/x/') THEN 1.5 WHEN starts_with(np,'meetings/') THEN 1.0 ELSE 0.5 END"


@query(ORDERS_SQL + f"""SELECT id, round(CASE WHEN starts_with(np,'concepts/') THEN 1.0 ELSE {FLOOR} + (1 - {FLOOR}) * pow(0.5, age / {HALF}) END, 8) AS decay,
 round(CASE WHEN starts_with(np,'concepts/') THEN 1.0 ELSE 1 + {COEF} * {BHALF} / ({BHALF} + age) END, 8) AS boost,
 round(CASE WHEN starts_with(np,'concepts/') THEN 1.0 ELSE 1 + 1.5 * {COEF} * {BHALF} / ({BHALF} + age) END, 8) AS strong_boost FROM p""")
def recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recency decay and boosts by path prefix at a fixed now."""
    h = order_hits(spark, sf_dir).select("id", R.normalized_path(F.col("path")).alias("path"), R.age_days(F.col("updated_at"), F.lit(NOW).cast("timestamp")).alias("age"))
    path, age = F.col("path"), F.col("age")
    return h.select("id", F.round(R.recency_decay(path, age), 8).alias("decay"), F.round(R.recency_boost(path, age), 8).alias("boost"), F.round(R.recency_boost(path, age, True), 8).alias("strong_boost"))


@query(ORDERS_SQL + """, r AS (SELECT *, row_number() OVER (PARTITION BY query_id, document_id ORDER BY score DESC, id) AS n FROM p)
SELECT query_id, document_id, id, round(score, 8) AS score FROM r WHERE n = 1""")
def maxpool_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best chunk of each document."""
    return S.best_per_document(order_hits(spark, sf_dir)).select("query_id", "document_id", "id", F.round("score", 8).alias("score"))


RANKED_SQL = ORDERS_SQL + ", k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM p), t AS (SELECT * FROM k WHERE rank <= 50)"


@query(RANKED_SQL + ", c AS (SELECT *, row_number() OVER (PARTITION BY query_id, document_id ORDER BY rank) AS n FROM t) SELECT query_id, id, rank FROM c WHERE n <= 2")
def cap_per_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most two hits of a document among the top 50 of each query."""
    return S.cap_per_document(S.top_k(order_hits(spark, sf_dir), 50), 2).select("query_id", "id", "rank")


@query(RANKED_SQL + """, c AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n, row_number() OVER (PARTITION BY query_id, type ORDER BY rank) AS nth FROM t),
g AS (SELECT query_id, count(DISTINCT type) AS kinds FROM t GROUP BY 1)
SELECT c.query_id, id, rank FROM c JOIN g USING (query_id) WHERE kinds <= 1 OR nth <= greatest(ceil(n * 0.2), 1)""")
def type_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most a fifth of a query's hits from one type."""
    return S.diversify_types(S.top_k(order_hits(spark, sf_dir), 50), 0.2).select("query_id", "id", "rank")


@query(KEYWORD_SQL + """, c AS (SELECT query_id, r.id, rank, CAST(sum(ceil(length(text) / 4.0)) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS BIGINT) AS spent
FROM r JOIN documents d ON d.doc_id = r.id WHERE rank <= 50) SELECT query_id, id, rank, spent FROM c WHERE spent <= 12000""")
def token_budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix of a ranking whose texts fit a token budget."""
    hits = keyword_hits(texts(spark, sf_dir, "documents", "doc_id", "text"), 50)
    costs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), S.estimated_tokens(F.col("text")).alias("cost"))
    return S.within_token_budget(hits.join(costs, "id"), 12000, F.col("cost")).select("query_id", "id", "rank", F.col("spent").cast("long").alias("spent"))


@query(RANKED_SQL + ", m AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM t) SELECT query_id, id FROM m WHERE score >= best * 0.95")
def floor_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits near their query's best score."""
    return S.floor_gate(S.top_k(order_hits(spark, sf_dir), 50), 0.95).select("query_id", "id")


@query(RANKED_SQL + """, s AS (SELECT *, row_number() OVER (PARTITION BY query_id, CAST(document_id % 5 AS VARCHAR) ORDER BY score DESC, id) AS n FROM t)
SELECT query_id, id, round(CASE WHEN n > 1 THEN score * 0.95 ELSE score END, 6) AS score FROM s""")
def session_demotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All but the best hit of a session are demoted."""
    hits = S.top_k(order_hits(spark, sf_dir), 50).withColumn("session", (F.col("document_id") % 5).cast("string"))
    return S.demote_same_session(hits).select("query_id", "id", F.round("score", 6).alias("score"))


@query(RANKED_SQL + """, e AS (SELECT *, id % 11 = 0 AS title_hit, id % 3 = 0 AS keyword_hit, id % 2 = 0 AS vector_hit FROM t),
k2 AS (SELECT *, CASE WHEN title_hit THEN 'title' WHEN vector_hit AND keyword_hit AND rank <= 3 THEN 'high_vector' WHEN keyword_hit THEN 'keyword' ELSE 'weak' END AS evidence FROM e)
SELECT query_id, id, evidence, CASE evidence WHEN 'title' THEN 'exists' WHEN 'weak' THEN 'unknown' ELSE 'probable' END AS create_safety FROM k2""")
def evidence_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence and create-safety labels of hits."""
    hits = S.top_k(order_hits(spark, sf_dir), 50).withColumns({"title_hit": F.col("id") % 11 == 0, "keyword_hit": F.col("id") % 3 == 0, "vector_hit": F.col("id") % 2 == 0})
    return S.evidence(hits).select("query_id", "id", "evidence", "create_safety")


@query(RANKED_SQL + """, i AS (SELECT *, CASE query_id % 3 WHEN 0 THEN 'factual' WHEN 1 THEN 'exact' ELSE 'topic' END AS intent FROM t)
SELECT query_id, id, intent FROM i WHERE rank <= CASE WHEN intent IN ('factual', 'exact') THEN 2 ELSE 6 END""")
def adaptive_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fewer rows for factual and exact queries."""
    intent = F.element_at(F.array(F.lit("factual"), F.lit("exact"), F.lit("topic")), (F.col("query_id") % 3 + 1).cast("int"))
    return S.adaptive_return(S.top_k(order_hits(spark, sf_dir), 50).withColumn("intent", intent)).select("query_id", "id", "intent")


@query(RANKED_SQL + """, a AS (SELECT query_id, id, rank FROM t WHERE rank <= 20), b0 AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY id) AS rank FROM t),
b AS (SELECT b0.* FROM b0 JOIN a USING (query_id, id)), u AS (SELECT * FROM a UNION ALL SELECT * FROM b)
SELECT query_id, id, round(sum(1 / (60 + rank)), 8) AS score FROM u GROUP BY 1, 2""")
def refine_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fusion with a refining search, restricted to the primary hits."""
    t = S.top_k(order_hits(spark, sf_dir), 50).select("query_id", "id", "rank")
    second = S.top_k(t.withColumn("score", -F.col("id")).drop("rank"), 50)
    return S.refine(t.where("rank <= 20"), second).select("query_id", "id", F.round("score", 8).alias("score"))


@query("""SELECT r.r_name AS title, q.query_id, len(string_split(lower(r.r_name), ' ')) AS size FROM region r,
(VALUES ('q1', ' who sells to the middle east and africa '), ('q2', ' asia ')) q(query_id, query) WHERE contains(q.query, ' ' || lower(r.r_name) || ' ')""")
def title_arm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles that occur as a run of query tokens, by an equi join on the query's n-grams."""
    docs = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("title"))
    queries = spark.createDataFrame([("q1", "Who sells to the Middle East and Africa?"), ("q2", "ASIA")], "query_id string, query string")
    return S.title_arm(docs, queries, 10).join(docs, "id").select("title", "query_id", F.col("score").cast("long").alias("size"))


QUERY_TEXTS = ['"exact words"', "how do I reset it", "what is the plan", "latest history of x", "meeting 2024-05 notes", "all the tools we use", "plain topic", "", "compare the landscape of tools", "list all papers on joins"]


@query("""WITH q(query) AS (VALUES ('"exact words"'), ('how do I reset it'), ('what is the plan'), ('latest history of x'), ('meeting 2024-05 notes'), ('all the tools we use'), ('plain topic'), (''), ('compare the landscape of tools'), ('list all papers on joins'))
SELECT query, CASE WHEN trim(query) = '' THEN 'topic' WHEN starts_with(query, '"') AND ends_with(query, '"') THEN 'exact'
 WHEN regexp_matches(query, '(?i)\\bhow (?:do|to|can|should)\\b') THEN 'howto' WHEN regexp_matches(query, '(?i)\\b(?:when|what|who|where|which) (?:is|was|did)\\b') THEN 'factual'
 WHEN regexp_matches(query, '(?i)\\b(when|recent(ly)?|history|timeline|latest)\\b|\\blast\\s+(week|month|quarter|year)\\b|\\b\\d{4}[-/]\\d{2}\\b') THEN 'personal' ELSE 'topic' END AS intent,
 len(regexp_split_to_array(query, '\\s+')) >= 3 AND regexp_matches(query, '(?i)\\ball\\s+(the\\s+)?(tools|papers)\\b|\\blist\\s+all\\b|\\bthe\\s+landscape\\s+of\\b') AS concept_shaped FROM q""".replace("\\\\", "\\"))
def query_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule-based intent and concept shape of queries."""
    q = spark.createDataFrame([(t,) for t in QUERY_TEXTS], "query string")
    return q.select("query", R.query_intent(F.col("query")).alias("intent"), R.concept_shaped(F.col("query")).alias("concept_shaped"))


@query()
def neardup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token-set near duplicates of documents: each document's class of equal sets and its links to other classes, by prefix
    filtering on rare tokens."""
    from tessera.operators.dedup import near_duplicate_classes

    tokens = F.array_distinct(F.filter(F.split(F.lower("text"), r"\s+"), lambda t: t != ""))
    d = texts(spark, sf_dir, "documents", "doc_id", "text").select(F.col("doc_id").alias("id"), tokens.alias("tokens"))
    return near_duplicate_classes(d, 0.85).select(F.col("id").alias("doc_id"), "class_id", "links")


@query("""WITH e AS (SELECT vec_id % 7 AS doc, vec_id, embedding::DOUBLE[] AS v FROM embeddings), g AS (SELECT label, embedding::DOUBLE[] AS c FROM embeddings WHERE vec_id % 20 = 0)
SELECT vec_id, label, round(1 - list_cosine_similarity(v, c), 5) AS distance FROM e, g WHERE list_cosine_similarity(v, c) >= 0.2""")
def semantic_cache_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine distance of vectors to a stated block of cached queries."""
    v = table(spark, sf_dir, "embeddings").withColumn("bucket", F.lit(0))
    cached = v.where("vec_id % 20 = 0").select(F.col("label").alias("key"), "bucket", F.col("embedding").alias("vector"))
    pairs = QC.near_vectors(v.select(F.col("vec_id").alias("query_id"), "bucket", F.col("embedding").alias("vector")), cached, 0.2)
    return pairs.select(F.col("query_id").alias("vec_id"), F.col("key").alias("label"), F.round(1 - F.col("similarity"), 5).alias("distance"))


CACHE_SQL = """
WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
asked AS (SELECT a.vec_id AS query_id, a.label AS bucket, list_transform(list_zip(a.v, b.v), lambda p: p[1] + (CASE WHEN a.vec_id % 40 = 0 THEN 0.3 ELSE 0.6 END) * p[2]) AS q FROM e a JOIN e b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 20 IN (0, 1)),
cache AS (SELECT vec_id AS key, label AS bucket, v, CASE WHEN vec_id % 3 = 0 THEN 7 ELSE 5 END AS clock, vec_id % 90 AS age, CASE WHEN vec_id % 11 <> 0 THEN vec_id END AS document_id, vec_id % 3 + (vec_id % 5 = 0)::INT AS seen,
  CASE WHEN vec_id % 13 = 0 THEN 0 ELSE vec_id % 4 + 1 END AS n_results FROM e),
fresh AS (SELECT c.*, clock = 7 OR coalesce(d.doc_id % 3 = seen, false) AS fresh FROM cache c LEFT JOIN documents d ON d.doc_id = c.document_id)
"""


def answer_cache(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """An entry for every vector, of two clocks, some without documents or results, some whose document changed or is gone; and the documents."""
    k = F.col("vec_id")
    seen = F.create_map(k, k % 3 + (k % 5 == 0).cast("int"))
    results = F.when(k % 13 == 0, F.array().cast("array<long>")).otherwise(F.array_repeat(k, (k % 4 + 1).cast("int")))
    cache = table(spark, sf_dir, "embeddings").select(
        k.alias("key"), F.col("label").alias("bucket"), F.col("embedding").alias("vector"), F.when(k % 3 == 0, 7).otherwise(5).alias("clock"),
        F.when(k % 11 == 0, F.map_from_arrays(F.array().cast("array<long>"), F.array().cast("array<long>"))).otherwise(seen).alias("doc_generations"),
        (F.lit(NOW).cast("timestamp") - F.make_dt_interval(mins=(k % 90).cast("int"))).alias("stored_at"), F.concat(F.lit("i"), k % 2).alias("intent"), results.alias("result_ids"),
    )
    return cache, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), (F.col("doc_id") % 3).alias("generation"))


@query(CACHE_SQL + """, s AS (SELECT query_id, key, list_cosine_similarity(q, v) AS s, n_results FROM asked JOIN fresh USING (bucket) WHERE fresh AND age < 60),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, key) AS n FROM s WHERE s > 0.92)
SELECT query_id, key, round(s, 6) AS similarity, 'i' || (key % 2) AS intent, n_results FROM r WHERE n = 1 AND n_results > 0""")
def cached_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest young and fresh cached answer to each question of a stated block, by an exact threshold join."""
    cache, documents = answer_cache(spark, sf_dir)
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("next"))
    own = table(spark, sf_dir, "embeddings").where("vec_id % 20 IN (0, 1)")
    weight = F.when(F.col("query_id") % 40 == 0, 0.3).otherwise(0.6)
    both = own.select(F.col("vec_id").alias("query_id"), F.col("label").alias("bucket"), "embedding").join(v.withColumn("query_id", F.col("vec_id") - 1), "query_id")
    asked = both.select("query_id", "bucket", F.zip_with("embedding", "next", lambda a, b: a.cast("double") + weight * b.cast("double")).alias("vector"))
    hits = QC.semantic_hits(asked, cache, documents, 7, F.lit(NOW).cast("timestamp"))
    return hits.select("query_id", "key", F.round("similarity", 6).alias("similarity"), "intent", F.size("result_ids").cast("long").alias("n_results"))


@query(CACHE_SQL + "SELECT key, clock::INT AS clock, fresh FROM fresh")
def cache_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each cached answer may still be served."""
    cache, documents = answer_cache(spark, sf_dir)
    return QC.with_freshness(cache, documents, 7).select("key", "clock", "fresh")


@query(CACHE_SQL + "SELECT bucket, count(*) AS kept, min(key) AS first_key, max(age) AS oldest FROM fresh WHERE fresh GROUP BY 1")
def cache_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What pruning leaves of a cache, by bucket."""
    kept = QC.pruned(*answer_cache(spark, sf_dir), 7)
    age = F.timestamp_diff("MINUTE", F.col("stored_at"), F.lit(NOW).cast("timestamp"))
    return kept.groupBy("bucket").agg(F.count("*").alias("kept"), F.min("key").alias("first_key"), F.max(age).alias("oldest"))


@query(CACHE_SQL + "SELECT key, 'i' || (key % 2) AS intent, n_results FROM fresh WHERE fresh AND n_results > 0 AND key % 2 = 0")
def cached_exactly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fresh answers to every second key."""
    cache, documents = answer_cache(spark, sf_dir)
    found = QC.exact_hits(cache.where("key % 2 = 0").select("key"), cache, documents, 7)
    return found.select("key", "intent", F.size("result_ids").cast("long").alias("n_results"))


@query(r"""SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens, md5(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS claim_key,
len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS n_words, substr(sha256(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))), 1, 16) AS value_hash FROM documents""")
def text_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token estimate, claim key, word count and value hash."""
    d, t = table(spark, sf_dir, "documents"), F.col("text")
    return d.select("doc_id", X.estimated_tokens(t).alias("tokens"), X.claim_key(t).alias("claim_key"), F.size(X.tokens(t)).alias("n_words"), X.value_hash(t).alias("value_hash"))


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '(?i)\b[\w.%+-]+@[a-z0-9.-]+\.[a-z]{2,}\b')) AS n_emails,
CAST((length(text) - length(replace(text, chr(10), ''))) AS INTEGER) AS n_breaks FROM documents""")
def email_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-mail addresses of documents, counted by regular expression."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.size(F.regexp_extract_all("text", F.lit(r"(?i)\b[\w.%+-]+@[a-z0-9.-]+\.[a-z]{2,}\b"), 0)).alias("n_emails"), (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))).alias("n_breaks"))


@query()
def pii_scrubbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with personal data masked, where that changes them (word boundaries differ between engines)."""
    d = texts(spark, sf_dir, "documents", "doc_id", "text").withColumn("scrubbed", X.scrub_pii(F.col("text")))
    return d.where("scrubbed <> text").select("doc_id", "scrubbed")


@query(r"""SELECT page_id, round(1 - length(regexp_replace(regexp_replace(html, '(?i)</?[a-z][^>]{0,512}>', '', 'g'), '\s+', '', 'g')) / length(regexp_replace(html, '\s+', '', 'g')), 6) AS tag_share,
regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages""")
def page_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a page that is tags, and its title."""
    p, bare = table(spark, sf_dir, "pages"), lambda c: F.length(F.regexp_replace(c, r"\s+", ""))
    share = 1 - bare(F.regexp_replace("html", r"(?i)</?[a-z][^>]{0,512}>", "")) / bare(F.col("html"))
    return p.select("page_id", F.round(share, 6).alias("tag_share"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query(r"""WITH p AS (SELECT page_id, ['404', 'Error 503', 'Just a moment..', 'How to handle access denied errors', 'Attention required! | Cloudflare'][page_id % 6 + 1] AS t,
 coalesce(['Forbidden' || chr(10), 'Access denied now' || chr(10), 'a cloudflare RAY id: 7 '][page_id % 5 + 1], '') || html AS body, html FROM pages),
q AS (SELECT *, coalesce(t, regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title,
 regexp_replace(regexp_replace(body, '(?s)```.*?(```|\z)', ' ', 'g'), '`[^`\n]*`', ' ', 'g') AS bare FROM p),
r AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(bare, '(?i)</?[a-z][^>]{0,512}>', '', 'g'), '!\[[^\]]{0,512}\]\([^)]{0,512}\)', '', 'g'), '\[([^\]]{0,512})\]\([^)]{0,512}\)', '\1', 'g'), 'https?://\S+', '', 'g') AS prose FROM q),
m AS (SELECT *, 1 - length(regexp_replace(prose, '\s+', '', 'g')) / length(regexp_replace(bare, '\s+', '', 'g')) AS ratio, octet_length(encode(body)) AS size FROM r)
SELECT page_id, list_filter([CASE WHEN page_id % 6 = 4 THEN 'cloudflare_attention_required' END, CASE WHEN page_id % 5 = 2 THEN 'cloudflare_ray_id' END, CASE WHEN page_id % 5 = 1 THEN 'access_denied' END,
 CASE WHEN page_id % 6 < 2 THEN 'error_page_title' END, CASE WHEN page_id % 6 = 2 THEN 'cloudflare_challenge_title' END, CASE WHEN size > 500000 THEN 'too_large' WHEN size > 50000 THEN 'large' END,
 CASE WHEN size > 50000 AND size <= 500000 AND ratio > 0.85 THEN 'mostly_markup' END], lambda x: x IS NOT NULL) AS flags, round(ratio, 6) AS markup_ratio FROM m""".replace("\\", "\\"))
def page_sanity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content sanity flags and markup ratio of pages; some get titles and openings that fetched error pages have, or only seem to."""
    k = F.col("page_id")
    title = F.coalesce(F.get(F.array(*map(F.lit, ("404", "Error 503", "Just a moment..", "How to handle access denied errors", "Attention required! | Cloudflare"))), (k % 6).cast("int")), F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    opening = F.coalesce(F.get(F.array(*map(F.lit, ("Forbidden\n", "Access denied now\n", "a cloudflare RAY id: 7 "))), (k % 5).cast("int")), F.lit(""))
    p = table(spark, sf_dir, "pages").select(k, title.alias("title"), F.concat(opening, "html").alias("body"))
    return p.select("page_id", X.sanity_flags(F.col("body"), F.col("title")).alias("flags"), F.round(X.markup_ratio(F.col("body")), 6).alias("markup_ratio"))


@query("""WITH n AS (SELECT n_name, lower(n_name) AS s FROM nation),
g AS (SELECT n_name, list_distinct(flatten(list_transform(string_split(s, ' '), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))) AS t FROM n)
SELECT a.n_name AS a, b.n_name AS b, round(len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))), 6) AS similarity
FROM g a JOIN g b ON a.n_name < b.n_name AND len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))) >= 0.1""")
def trigram_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names alike by trigrams, joined on shared trigrams rather than compared all with all."""
    n = table(spark, sf_dir, "nation").select("n_name", X.trigrams(F.col("n_name")).alias("t"))
    g = n.select("n_name", F.size("t").alias("n"), F.explode("t").alias("g"))
    a, b = g.select(F.col("n_name").alias("a"), F.col("n").alias("na"), "g"), g.select(F.col("n_name").alias("b"), F.col("n").alias("nb"), "g")
    shared = a.join(b, "g").where("a < b").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("i"))
    sim = F.col("i") / (F.col("na") + F.col("nb") - F.col("i"))
    return shared.where(sim >= 0.1).select("a", "b", F.round(sim, 6).alias("similarity"))
