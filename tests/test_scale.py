"""Results and plans that only larger tables show."""

import ast
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.operators import budgets as B
from tessera.operators import chunking as CH
from tessera.operators import dedup
from tessera.operators import evaluation as E
from tessera.operators import facts as K
from tessera.operators import fulltext as FT
from tessera.operators import graph as G
from tessera.operators import ingest as I
from tessera.operators import mentions as M
from tessera.operators import querycache as QC
from tessera.operators import reads as D
from tessera.llm import quality
from tessera.plans import queries
from tessera.sources import exports as EX
from tessera.sources import sweep as SW


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_equal_experts_go_to_the_lesser_node(spark):
    hits = spark.createDataFrame([(2, 4.0000000001), (1, 4.0), (3, 3.0)], "node int, score double").withColumns({"updated_at": F.lit("2024-01-01").cast("date"), "salience": F.lit(0.5)})
    assert [r.node for r in G.experts_by_topic(hits, F.lit("2024-02-01").cast("date"), 2).collect()] == [1, 2]


def test_costs_of_a_half_are_rounded_to_even(spark, tmp_path):
    spark.createDataFrame([(1, 7, 198500.0), (2, 7, 1500.0)], "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(7,)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    got = {(r.arm, r.id): r.cost for r in queries()["recall_budget"](spark, str(tmp_path)).collect()}
    assert got == {("fact", 1): 198, ("fact", 2): 2, ("timeline", 1): 30, ("timeline", 2): 30, ("page", 0): 740}


def test_texts_are_not_broadcast_to_their_mentions(spark):
    texts = spark.createDataFrame([(1, "Ada Lovelace met Grace Hopper")], "id int, text string")
    names = spark.createDataFrame([("ada lovelace", "a"), ("grace hopper", "g")], "phrase string, slug string")
    found = M.name_matches(texts, names)
    assert "BroadcastHashJoin [id" not in plan(found) and {r.slug for r in found.collect()} == {"a", "g"}


def test_nearest_facts_come_from_products_of_blocks(spark):
    r = np.random.default_rng(1)
    new = [(i, f"e{i % 3}", [float(x) for x in r.normal(size=4)]) for i in range(40)] + [(90, "e0", None), (91, "none", [1.0, 0.0, 0.0, 0.0]), (92, "e1", [0.0] * 4)]
    stored = [(100 + i, f"e{i % 2}", [float(x) for x in r.normal(size=4)]) for i in range(30)] + [(200, "e2", [2.0, 0.0, 0.0, 0.0]), (150, "e2", [1.0, 0.0, 0.0, 0.0]), (201, "e2", None)]
    frame = lambda rows: spark.createDataFrame(rows, "id long, entity_slug string, embedding array<double>")
    found = K.duplicates(frame(new), frame(stored))
    assert plan(found).count("MapInArrow") >= 3  # no pair of vectors is a row
    cosine = lambda a, b: float(np.dot(a, b) / ((np.linalg.norm(a) * np.linalg.norm(b)) or 1))
    for row in found.collect():
        entity, v = next((e, v) for i, e, v in new if i == row.id)
        near = sorted((-round(cosine(v, w), 12), i) for i, e, w in stored if e == entity and v and w)
        assert (row.stored_id, None if row.similarity is None else round(row.similarity, 9)) == ((near[0][1], round(-near[0][0], 9)) if near else (None, None))


def test_threshold_joins_make_no_row_of_a_pair(spark):
    r = np.random.default_rng(2)
    rows = spark.createDataFrame([(i, 0, [float(x) for x in r.normal(size=6)]) for i in range(30)], "key long, bucket int, vector array<double>")
    near = QC.near_vectors(rows.withColumnRenamed("key", "query_id"), rows, 0.2)
    assert "zip_with" not in plan(near) and near.where("query_id = key").count() == 30


def test_label_arm_pairs_no_query_with_all_rows_of_its_label(spark, tmp_path):
    spark.createDataFrame([(i, [1.0, float(i)], 0) for i in range(200)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    hits = queries()["hybrid_rrf"](spark, str(tmp_path))
    assert hits.count() > 0
    text = plan(hits)
    assert "WindowGroupLimit [label" in text


def test_intervals_over_blocks_equal_the_plain_ones(spark):
    values = np.random.default_rng(4).normal(size=157).round(3)
    rows = spark.createDataFrame([(int(i), float(values[i])) for i in np.random.default_rng(5).permutation(157)], "query_id long, d double").repartition(3)
    got = E.paired_interval(rows, block=50).first()
    assert got.queries == 157 and np.allclose((got.delta, got.lo, got.hi), E.mean_interval(values), atol=1e-12)
    assert tuple(E.paired_interval(rows.where("query_id < 0")).first()) == (0, 0.0, 0.0, 0.0)
    assert E.uniform(42, 5, 2**32 + 3).tolist() == E.uniform(42, 8).tolist()[3:]


def test_exports_deal_a_frequent_value_to_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(EX, "FILES_A_TASK", 2)
    rows = spark.range(1003, numPartitions=5).withColumn("kind", F.when(F.col("id") % 100 == 0, None).otherwise("k"))
    dealt = EX._dealt(rows, ["kind"], 10)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert dealt.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 700
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    EX.export_rows(rows, f"{tmp_path}/x", "json", ["kind"], 10)
    back = EX.read_back(spark, f"{tmp_path}/x", rows.schema, "json")
    assert {(r.kind, r.n, r.files) for r in back.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("_metadata.file_path").alias("files")).collect()} == {("k", 992, 100), (None, 11, 2)}


def test_common_words_are_counted_over_whole_texts(spark):
    rows = [("en", "start " + "filler " * 400 + "Tail " * 500)] + [("en", "a b c")] * 3
    assert quality.common_words(spark.createDataFrame(rows, "lang string, text string"))["en"][:2] == [b"tail", b"filler"]


def test_unlike_sets_are_refused_before_their_tokens_meet(spark):
    words = [f"w{k}" for k in range(400)]
    sets = [words[:300], words[:290], words[150:], words[:2], ["x"], [], None, words[:300]]
    docs = spark.createDataFrame(list(enumerate(sets)), "id int, tokens array<string>")
    pairs = dedup.jaccard_pairs(docs, 0.85)
    assert plan(pairs).count("bit_count") >= 2 and [(r.a, r.b) for r in pairs.collect()] == [(0, 1)]
    got = {r.id: (r.class_id, r.links) for r in dedup.near_duplicate_classes(docs, 0.85).collect()}
    assert got == {0: (0, 1), 1: (1, 1), 2: (2, 0), 3: (3, 0), 4: (4, 0), 5: (5, 0), 6: (5, 0), 7: (0, 1)}


def test_postings_are_joined_to_no_query(spark):
    docs = spark.createDataFrame([(i, "common words here" + (" rare" if i == 7 else "")) for i in range(50)], "id int, text string")
    terms = FT.numbered_terms(spark.createDataFrame([(1, "common rare"), (2, "common absent"), (3, "words here")], "query_id int, query string"))
    hits = FT.cover_density_hits(FT.positional_index(docs, "id", {"B": F.col("text")}), terms)
    assert "collect_list(named_struct(number" not in plan(hits) and "collect_list(struct(number" not in plan(hits)
    found = [(r.query_id, r.id) for r in hits.collect()]
    assert sorted(found) == [(1, 7)] + [(3, i) for i in range(50)]


def test_replacements_by_nothing_do_not_meet_in_one_task(spark):
    facts = spark.createDataFrame([(i, f"e{i % 50}", None) for i in range(4000)], "id long, entity_slug string, superseded_by long")
    gone = spark.range(4000).select(F.col("id").alias("old_id"), F.lit(-1).cast("long").alias("new_id"))
    good = spark.createDataFrame([(1, 51), (1, 101), (2, 3), (4, 4)], "old_id long, new_id long")
    replaced = D.superseded(facts, gone.unionByName(good))
    assert "hashpartitioning(new_id" not in plan(replaced) or "hashpartitioning(new_id#" in plan(replaced) and ", entity_slug" in plan(replaced)
    assert [(r.id, r.superseded_by) for r in replaced.where("superseded_by IS NOT NULL").collect()] == [(1, 51)]


def test_calls_are_named_as_unparsing_names_them(spark):
    calls = ["f()", "a.b.c()", "a().b()", "x[1].y()", "(lambda: 1)()", "'s'.join()", "self.m()"]
    assert sorted(ast.unparse(ast.parse(c).body[0].value.func) for c in calls) == sorted(CH._called(ast.parse(c).body[0].value.func) for c in calls)


def test_code_files_are_dealt_out(spark):
    assert queries()["code_symbols"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism


def test_texts_are_chunked_and_embedded_in_slices(spark, monkeypatch):
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.array(["x" * 1_500_000, None, "y" * 5_000_000, "z"])], names=["id", "text"])
    assert [b.column(0).to_pylist() for b in CH.text_slices(iter([batch]), 1)] == [[1, 2, 3], [4]]
    texts = spark.createDataFrame([("One two two",), (None,), ("été, un_deux",)], "text string")
    assert [sum(r.v) for r in texts.select(I.hashed_embedding("text").alias("v")).collect()] == [3, 0, 3]
    assert "ArrowEvalPython" in plan(texts.select(I.hashed_embedding("text")))


def test_a_sweep_lists_its_folder_once(spark, tmp_path, monkeypatch):
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "a.md").write_text("one")
    listed, list_files = [], SW.folder_files
    monkeypatch.setattr(SW, "folder_files", lambda *a: listed.append(a) or list_files(*a))
    store = SW.file_store(spark, f"{tmp_path}/store")
    SW.sweep(store, f"{tmp_path}/files", 1)
    assert [r.text for r in store.rows().collect()] == ["one"] and len(listed) == 1


def test_a_set_goes_to_tiles_and_not_to_each_of_its_pairs(spark):
    words = [f"w{k}" for k in range(60)]
    sets = [sorted(set(words) - {words[i]} | {f"own{i}"}) for i in range(40)] + [[f"x{i}"] for i in range(20)]
    docs = spark.createDataFrame(list(enumerate(sets)), "id int, tokens array<string>")
    want = {(i, j) for i in range(40) for j in range(i + 1, 40)}
    found = dedup.jaccard_pairs(docs, 0.85)
    assert "array_intersect" not in plan(found) and {(r.a, r.b) for r in found.collect()} == want
    # parts of both sides, and blocks of what goes where, change nothing
    pairs = spark.createDataFrame([(a, b, 7) for a, b in want] + [(40, 41, 8)], "a int, b int, w long")
    rows = docs.select(F.col("id").alias("rep"), "tokens")
    for tile_sets, block_rows in ((4, 50), (512, 1_000_000)):
        got = dedup._verified(pairs, rows, 0.85, tile_sets, block_rows).collect()
        assert {(r.a, r.b) for r in got} == want and {round(r.jaccard, 6) for r in got} == {round(58 / 62, 6)}


def test_pairs_near_the_threshold_are_those_of_brute_force(spark):
    r = random.Random(9)
    sets = []
    for size in (40, 90, 200):
        base = [f"s{size}t{k}" for k in range(size)]
        for share in (0.02, 0.05, 0.08, 0.09, 0.12):
            for _ in range(5):
                sets.append(sorted({w if r.random() > share else f"n{r.random()}" for w in base} | {f"common{k}" for k in range(8)}))
    docs = spark.createDataFrame(list(enumerate(sets)), "id int, tokens array<string>")
    whole = [set(s) for s in sets]
    first = [i for i, x in enumerate(whole) if whole.index(x) == i]  # equal sets are one class
    like = {(i, j): len(whole[i] & whole[j]) / len(whole[i] | whole[j]) for i in first for j in first if i < j}
    got = {(x.a, x.b): x.jaccard for x in dedup.jaccard_pairs(docs, 0.85).collect()}
    assert {k: round(v, 9) for k, v in got.items()} == {k: round(v, 9) for k, v in like.items() if v > 0.85} and len(got) > 50 and sum(0.75 < v <= 0.85 for v in like.values()) > 50
