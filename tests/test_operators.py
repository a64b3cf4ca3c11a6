"""Operators on small hand-made rows: hand-computed values, nulls, empty scopes, ties."""

import random

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import rank as R
from tessera.functions import stats as M
from tessera.functions import text as X
from tessera.operators import chunking as C
from tessera.operators import evaluation as E
from tessera.operators import facts as K
from tessera.operators import graph as G
from tessera.operators import pages as P
from tessera.operators import search as S
from tessera.sources import files
from tessera.sources import transcripts as H


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_rrf_uses_the_default_for_weights_of_zero(spark):
    assert one(spark, R.rrf(F.lit(1)), R.rrf(F.lit(1), F.lit(1.2)), R.rrf(F.lit(2), F.lit(0.0)))[:] == pytest.approx((1 / 61, 1 / 51, 1 / 62))


def test_longest_prefix_wins(spark):
    paths = [("media/x/1", 0.7), ("media/articles/1", 1.1), ("page://originals/a", 1.5), ("page-truth://chat/a", 0.5), ("mediax", 1.0)]
    got = spark.createDataFrame(paths, "path string, want double").select(R.curation(R.normalized_path(F.col("path"))), "want").collect()
    assert all(a == b for a, b in got)


def test_fact_confidence(spark):
    c = lambda kind, age, expired=False: R.fact_confidence(F.lit(0.8), F.lit(kind), F.lit(float(age)), F.lit(expired))
    assert one(spark, c("event", 7), c("odd", 999), c("fact", 0), c("fact", 1, True))[:] == pytest.approx((0.8 / math.e, 0.8, 0.8, 0.0))


def test_wilson_at_the_ends(spark):
    low0, high0 = M.wilson(F.lit(0), F.lit(10))
    low1, high1 = M.wilson(F.lit(10), F.lit(10))
    none, _ = M.wilson(F.lit(0), F.lit(0))
    r = one(spark, low0, high0, low1, high1, none)
    assert r[0] == 0 and r[3] == 1 and r[4] is None and r[1] == pytest.approx(0.2775, abs=1e-3) and r[2] == pytest.approx(0.7225, abs=1e-3)


def test_metrics(spark):
    a, rel = F.array(*map(F.lit, "abca")), F.array(F.lit("b"), F.lit("x"))
    r = one(spark, M.precision_at(a, rel, 3), M.recall_at(a, rel, 3), M.reciprocal_rank(a, rel), M.ndcg_at(a, rel, 3), M.reciprocal_rank(a, F.array(F.lit("z"))))
    assert r[:] == pytest.approx((1 / 3, 1 / 2, 1 / 2, (1 / math.log2(3)) / (1 + 1 / math.log2(3)), 0))


def test_bootstrap_is_seeded():
    # first numbers of the generator for seed 42, computed by hand from its definition
    def plain(seed):
        a = seed
        while True:
            a = (a + 0x6D2B79F5) & 0xFFFFFFFF
            t = ((a ^ (a >> 15)) * (a | 1)) & 0xFFFFFFFF
            t ^= (t + (((t ^ (t >> 7)) * (t | 61)) & 0xFFFFFFFF)) & 0xFFFFFFFF
            yield ((t ^ (t >> 14)) & 0xFFFFFFFF) / 4294967296

    g = plain(42)
    assert E.uniform(42, 50).tolist() == [next(g) for _ in range(50)]
    mean, lo, hi = E.mean_interval(np.array([0.0, 1.0, 0.5, 0.25]))
    assert lo <= mean <= hi and E.mean_interval(np.array([0.3, 0.3])) == (0.3, 0.3, 0.3) and E.mean_interval(np.array([])) == (0, 0, 0)


def test_pii_scrub(spark):
    text = "a.b@c.org Bearer abcdefghijkl tel +49 170 123456 on 2024-01-02 card 4111 1111 1111 1111 at 10.0.0.1"
    assert one(spark, X.scrub_pii(F.lit(text)))[0] == "[email] [token] tel [phone] on 2024-01-02 card [card] at [ip]"


def test_claim_keys_ignore_case_and_space(spark):
    r = one(spark, X.claim_key(F.lit("  Likes\n Tea ")), X.claim_key(F.lit("likes tea")), X.claim_key(F.lit(None).cast("string")))
    assert r[0] == r[1] and r[2] is None


def test_slugs(spark):
    got = spark.createDataFrame([("Crème Brûlée!",), ("日本 語",), (None,)], "t string").select(X.slugify("t"), X.alias_norm("t")).collect()
    assert [tuple(r) for r in got] == [("creme-brulee", "crème brûlée!"), ("日本-語", "日本 語"), (None, None)]


def test_empty_scope_reads_nothing(spark):
    f = spark.createDataFrame([(1, "a"), (2, None)], "id int, source_id string")
    assert K.in_scope(f, None).count() == 2 and K.in_scope(f, []).count() == 0 and [r.id for r in K.in_scope(f, ["a"]).collect()] == [1]


def test_forgetting_takes_twins(spark):
    now = F.lit("2024-01-01").cast("timestamp")
    f = spark.createDataFrame([(1, "e", "Likes tea", None), (2, "e", "likes  TEA", None), (3, "x", "likes tea", None)], "id long, entity_slug string, fact string, forgotten_at timestamp")
    assert {r.id for r in K.live(K.forget(f, [1], now)).collect()} == {3}


def test_walk_ends_on_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "a")], "src string, dst string")
    got = {r.node: r.depth for r in G.traverse(e, spark.createDataFrame([("a",)], "node string"), 10).collect()}
    assert got == {"a": 0, "b": 1, "c": 2}
    with pytest.raises(ValueError):
        G.traverse(e, e.select(F.col("src").alias("node")), 11)


def test_page_log(spark):
    log = spark.createDataFrame([("p", 1, "one", False), ("p", 2, "two", False), ("q", 1, "x", True)], "slug string, version_n int, body string, deleted boolean")
    writes = spark.createDataFrame([("p", "two", None), ("q", "x", None), ("r", "new", 0), ("p", "late", 1)], "slug string, body string, expected_version int")
    assert {(r.slug, r.version_n) for r in P.put(log, writes).collect()} == {("q", 2), ("r", 1)}
    assert [r.body for r in P.revert(log, spark.createDataFrame([("p", 1)], "slug string, target_version int")).collect()] == ["one"]
    assert [r.body for r in P.append(log, spark.createDataFrame([("p", "more")], "slug string, addition string")).collect()] == ["two\n\nmore"]
    assert [(r.slug, r.deleted) for r in P.marked(log, log.select("slug").distinct(), True).collect()] == [("p", True)]


def test_chunker(spark):
    text = "# A\n\n" + "word " * 30 + "\n\n" + "Sentence one is here. Sentence two follows it. " * 10 + "\n\n# B\nshort"

    def cut(text, **k):
        df = spark.createDataFrame([(1, text)], "doc_id int, text string")
        return [r.content for r in C.chunked(df, **k).orderBy("chunk_index").collect()]

    chunks = cut(text, limit=200, least=20, overlap=60)
    assert all(len(c) <= 400 for c in chunks) and chunks[0].startswith("# A") and chunks[-1].startswith("# B") and len(chunks) > 3
    assert cut(None) == [] and cut("") == [] and cut("---\na: b\n---\nbody") == ["body"] and cut("x", kind="plain") == ["x"]
    # short sections join the next one; a short last one stays
    assert cut("# a\nx\n# b\n" + "y" * 30 + "\n# c\nz", least=20) == ["# a\nx\n\n# b\n" + "y" * 30, "# c\nz"]
    # paragraphs are packed up to the limit, and continuations led in from a sentence's start, else a word's, else not at all
    assert cut("Aa bb cc dd. Eight nine ten eleven.\n\n" + "w" * 30, limit=60, least=5, overlap=30)[1] == "nine ten eleven.\n\n" + "w" * 30
    assert cut("q" * 50 + "\n\n" + "w" * 50, limit=60, least=5, overlap=30) == ["q" * 50, "w" * 50]
    assert cut("v" * 95, kind="plain", limit=40, least=5) == ["v" * 40, "v" * 40, "v" * 15]


def test_near_duplicate_hits(spark):
    words = " ".join(f"w{i}" for i in range(30))
    hits = spark.createDataFrame([(1, "a", 1, words), (1, "b", 2, words + " more"), (1, "c", 3, "few words"), (1, "d", 4, "few words")], "query_id int, id string, rank int, text string")
    assert [r.id for r in S.near_duplicate_texts(hits).orderBy("rank").collect()] == ["a", "c", "d"]


def test_cache_freshness(spark):
    entries = spark.createDataFrame([("k1", {"d1": 1, "d2": 2}), ("k2", {"d1": 0}), ("k3", {"gone": 1}), ("k4", {})], "key string, doc_generations map<string,long>")
    now = spark.createDataFrame([("d1", 1), ("d2", 2)], "document_id string, generation long")
    assert {r.key: r.fresh for r in S.cache_is_fresh(entries, now).collect()} == {"k1": True, "k2": False, "k3": False, "k4": True}


def test_packed_parts_carry_a_small_turn(spark):
    turns = spark.createDataFrame([("s", i, "x" * n) for i, n in enumerate((60, 20, 70, 90))], "session_id string, turn int, text string")
    assert sorted((r.part, r.turn) for r in H.packed_parts(turns, 100).collect()) == [(1, 0), (1, 1), (2, 1), (2, 2), (3, 3)]


def test_vault_scan(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "a/x.md").write_text("---\ntitle: T\n---\nbody")
    (tmp_path / "node_modules/y.md").write_text("no")
    (tmp_path / "z.txt").write_text("no")
    (tmp_path / "l.jsonl").write_text('{"a": 1}\nbroken\n{"a": 2}\n')
    got = files.scan_files(spark, str(tmp_path)).collect()
    assert [r.path.rpartition("/")[2] for r in got] == ["x.md"] and got[0].text.startswith("---")
    from pyspark.sql import types as T

    good, bad = files.json_lines(spark, str(tmp_path / "l.jsonl"), T.StructType([T.StructField("a", T.IntegerType())]))
    assert sorted(r.a for r in good.cache().collect()) == [1, 2] and [r.line for r in bad.collect()] == ["broken"]


def test_jaccard_pairs_against_all_pairs(spark):
    import itertools
    import random

    from tessera.operators.dedup import jaccard_pairs, token_classes

    r = random.Random(3)
    base = [r.sample("abcdefghijklmnop", 10) for _ in range(8)]
    sets = {i: frozenset(b if r.random() < 0.3 else set(b) ^ {r.choice("abcdefghijklmnop")}) for i, b in enumerate(base * 6)}
    df = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id int, tokens array<string>")
    first = {}
    for i, x in sets.items():
        first.setdefault(x, i)
    want = {(a, b): len(x & y) / len(x | y) for (x, a), (y, b) in itertools.combinations(first.items(), 2) if len(x & y) / len(x | y) > 0.8}
    assert {r.id: r.rep for r in token_classes(df).collect()} == {i: first[x] for i, x in sets.items()}
    assert {(x.a, x.b): x.jaccard for x in jaccard_pairs(df, 0.8).collect()} == pytest.approx(want)


def test_timeline_windows(spark):
    from tessera.operators import timeline as L

    days = [dt.datetime(2024, 2, 29), dt.datetime(2023, 2, 28), dt.datetime(2020, 2, 29), dt.datetime(2024, 3, 3), dt.datetime(2024, 3, 4)]
    e = spark.createDataFrame([(d,) for d in days], "occurred_at timestamp")
    day = F.lit("2024-02-29").cast("date")
    assert [r[0].year for r in L.on_this_day(e, day).collect()] == [2020]
    assert {r[0].day for r in L.in_week(e, day).collect()} == {29, 3}


def test_near_duplicate_classes_against_all_pairs(spark):
    from tessera.operators import dedup

    r = random.Random(3)
    sets = [sorted(set(r.choices("abcdefghijklmnop", k=r.randint(0, 14)))) for _ in range(120)]
    sets += sets[:20] + [[]] * 3
    got = {x.id: (x.class_id, x.links) for x in dedup.near_duplicate_classes(spark.createDataFrame(list(enumerate(sets)), "id int, tokens array<string>"), 0.7).collect()}
    first = {}
    for i, s in enumerate(sets):
        first.setdefault(tuple(s), i)
    for i, s in enumerate(sets):
        near = [o for o in first if o != tuple(s) and len(set(s) & set(o)) > 0.7 * len(set(s) | set(o))]
        assert got[i] == (first[tuple(s)], len(near))


def test_confidence_of_any_number_of_digits(spark):
    from tessera.operators import fences

    body = "<!-- facts:begin -->\n| # | claim | confidence |\n|---|---|---|\n| 1 | a | 0.875 |\n| 2 | b | x |\n<!-- facts:end -->"
    assert {r.claim: r.confidence for r in fences.fact_rows(spark.createDataFrame([("p", body)], "slug string, body string")).collect()} == {"a": 0.875, "b": 1.0}


def test_leader_clusters_have_no_limit_and_no_batches(spark):
    rng = np.random.default_rng(5)
    rows = [("s", None if i % 50 == 0 else f"e{i % 50 % 2}", i, None if i % 41 == 0 else [float(x) for x in rng.normal(size=4)]) for i in range(900)]
    want, leaders = {}, {}
    for _, entity, i, v in rows:
        u = np.zeros(4) if v is None else np.array(v) / np.linalg.norm(v)
        own = next((j for j, w in leaders.setdefault(entity, []) if u @ w >= 0.7), None)
        if own is None:
            leaders[entity].append((i, u))
        want[i] = i if own is None else own
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        df = spark.createDataFrame(rows, "source_id string, entity_slug string, id long, embedding array<double>").repartition(7)
        got = {r["id"]: r["leader"] for r in K.leader_clusters(df, 0.7).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want


def test_parts_equal_a_plain_greedy_pass_over_batches(spark):
    r = random.Random(9)
    turns = [(s, t, "x" * r.choice([0, 1, 5, 30, 90, 200])) for s in range(6) for t in range(60)]

    def plain(sizes, budget):
        out, current, part = [], [], 1
        used = lambda: sum(n for _, n in current) + 2 * (len(current) - 1) if current else 0
        for t, n in sizes:
            if current and used() + 2 + n > budget:
                out += [(part, x) for x, _ in current]
                last, part = current[-1], part + 1
                current = [last] if last[1] * 4 <= budget and last[1] + 2 + n <= budget else []
            current.append((t, n))
        return out + [(part, x) for x, _ in current]

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sorted(tuple(x) for x in H.packed_parts(spark.createDataFrame(turns, "session_id int, turn long, text string"), 120).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted((s, p, t) for s in range(6) for p, t in plain([(t, len(x)) for o, t, x in turns if o == s], 120))


def test_vector_arm_equals_brute_force_over_blocks(spark):
    rng = np.random.default_rng(3)
    vectors = [(f"v{i % 60:02d}-{i // 60}", [float(x) for x in np.random.default_rng(i % 60).normal(size=5)]) for i in range(150)] + [("zero", [0.0] * 5), ("none", None)]
    asked = [(i, [float(x) for x in rng.normal(size=5)]) for i in range(9)]
    unit = lambda v: np.array(v) / (np.linalg.norm(v) or 1.0)
    want = []
    for q, u in asked:
        best = sorted((-round(float(unit(u) @ unit(v)), 12), i) for i, v in vectors if v is not None)[:12]
        want += [(q, i, n) for n, (_, i) in enumerate(best, 1)]
    got = S.vector_arm(spark.createDataFrame(vectors, "id string, vector array<double>").repartition(3), spark.createDataFrame(asked, "query_id int, query_vector array<double>"), 12, rows=11)
    assert sorted((r["query_id"], r["id"], r["rank"]) for r in got.collect()) == sorted(want)
    assert S.vector_arm(spark.createDataFrame([], "id string, vector array<double>"), spark.createDataFrame(asked, "query_id int, query_vector array<double>"), 3).collect() == []


def test_junk_signs_of_fetched_pages(spark):
    pages = [("Attention Required! | Cloudflare", "cloudflare_attention_required"), ("Just a moment... x /cdn-cgi/challenge-platform", "cloudflare_just_a_moment"), ("a Cloudflare Ray ID: 7", "cloudflare_ray_id"),
             ("x\n\u00a0 Access denied", "access_denied"), ("please enable JavaScript and cookies to continue", "enable_javascript_cookies"), ("just a moment", "cloudflare_challenge_title")]
    got = spark.createDataFrame(pages, "text string, want string").select(X.sanity_flags(F.col("text")).alias("flags"), "want").collect()
    assert all(r["want"] in r["flags"] for r in got)
