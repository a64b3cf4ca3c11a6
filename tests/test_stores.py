"""Stores, connectors, the refusal ledger, sweeps and exports: retries, repeats, faults and odd input."""

import json
import os
import threading

import pytest
from pyspark.sql import functions as F

from tessera.sources import connectors as CN
from tessera.sources import exports as EX
from tessera.sources import sweep as SW
from tessera.sources.store import CommitConflict, Store
from tessera.streaming import ledger as LG
from tessera.streaming import streams as W


def a_store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"), "id long, v string, at int", F.pmod("id", F.lit(4)))


def rows(spark, *values):
    return spark.createDataFrame(list(values), "id long, v string, at int")


def contents(store, as_of=None):
    return sorted((r.id, r.v) for r in store.rows(as_of).collect())


def test_store_upserts_latest_and_keeps_other_parts(spark, tmp_path):
    store = a_store(spark, tmp_path)
    assert store.manifest().generation == 0 and contents(store) == []
    store.upsert(rows(spark, (1, "a", 1), (2, "b", 1), (5, None, None), (5, "x", 1)), ["id"], "at", "w", 0)
    first = store.files()
    store.upsert(rows(spark, (1, "old", 0), (1, "new", 2), (2, "tie", 1)), ["id"], "at", "w", 1, {"mark": "m"})
    assert contents(store) == [(1, "new"), (2, "b"), (5, "x")] and contents(store, 1) == [(1, "a"), (2, "b"), (5, "x")]
    assert len(first & store.files()) == 1 and store.manifest().facts == {"mark": "m"}
    before = store.manifest()
    assert store.upsert(rows(spark, (9, "again", 9)), ["id"], "at", "w", 1) == before  # the batch is there already
    assert store.upsert(rows(spark, (2, "older", 0)), ["id"], "at", "w", 2).parts == before.parts


def test_two_writers_lose_nothing(spark, tmp_path):
    store, failed = a_store(spark, tmp_path), []

    def write(name):
        try:
            for k in range(3):
                store.upsert(rows(spark, *[(100 * ord(name) + 10 * k + i, name, k) for i in range(6)]), ["id"], "at", name, k)
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=write, args=(n,)) for n in "ab"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and len(contents(store)) == 36 and store.manifest().generation == 6


def test_commit_conflicts_and_broken_manifests(spark, tmp_path):
    store = a_store(spark, tmp_path)
    base = store.upsert(rows(spark, (1, "a", 1)), ["id"], "at", "w", 0)
    with open(tmp_path / "store/manifests/000000000002.json", "w") as f:
        f.write('{"generation": 2, "par')
    assert store.manifest() == base and contents(store) == [(1, "a")]
    assert store.upsert(rows(spark, (2, "b", 1)), ["id"], "at", "w", 1).generation == 3
    with pytest.raises(CommitConflict):
        store._commit(base, {}, "late", 0, {})
    tries = []

    def rival(m):
        tries.append(m.generation)
        if len(tries) == 1:
            store.upsert(rows(spark, (3, "c", 1)), ["id"], "at", "rival", 0)
        return ["x"], rows(spark), {}

    assert store.change("slow", 0, rival).generation == 5 and tries == [3, 4] and len(contents(store)) == 3


def test_purge_drops_whole_parts_unread(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), "id long, v string, at int", F.col("at"))
    store.upsert(rows(spark, *[(i, "v", i % 4) for i in range(12)], (20, "n", None)), ["id"], "id", "w", 0)
    before = store.manifest().parts
    os.remove(next((tmp_path / "s/rows").glob("*/_part=0/part-*")))  # a part that is dropped is not opened
    after = store.purge((F.col("at") < 1) | (F.col("id") == 5), lambda p: {"0": True, "1": None}.get(p, False), "purge", 0).parts
    assert sorted(r.id for r in store.rows().collect()) == [1, 2, 3, 6, 7, 9, 10, 11, 20]
    assert "0" not in after and after["1"] != before["1"] and all(after[p] == before[p] for p in before if p not in "01")


def test_items_that_are_none_and_the_gap(spark, tmp_path):
    page = tmp_path / "pages/page=0"
    page.mkdir(parents=True)
    items = [{"number": 1, "title": "t", "updated_at": "2024-01-01T10:00:00"}, {"number": "x", "updated_at": "2024-01-01"}, {"title": "no number"}, {"number": 2, "updated_at": "2024-01-01 09:50:00", "title": None}, {"number": 3, "updated_at": "2024-01-01 09:00:00"}]
    (page / "a.json").write_text("\n".join([*map(json.dumps, items), "{not json", ""]))
    spark.dataSource.register(CN.PagedItems)
    read = spark.read.format("paged_items")
    assert sorted(r.number for r in read.load(str(tmp_path / "pages")).collect()) == [1, 2, 3]
    since = CN.since_for("2024-01-01 10:00:00")
    assert since == "2024-01-01 09:45:00" and CN.since_for(None) is None
    assert sorted(r.number for r in spark.read.format("paged_items").option("since", since).load(str(tmp_path / "pages")).collect()) == [1, 2]
    store = CN.page_store(spark, str(tmp_path / "store"), 2)
    done = CN.sync(store, str(tmp_path / "pages"), "c", "o/r", str(tmp_path / "state"), F.col("number") == 1)
    # a refused item holds the watermark no more than others
    assert done.facts == {"watermark:c": "2024-01-01 10:00:00"}
    assert {(r.slug, r.body) for r in store.rows().collect()} == {("github/o/r/2", "# \n\nState: \n\n"), ("github/o/r/3", "# \n\nState: \n\n")}
    again = CN.sync(store, str(tmp_path / "pages"), "c", "o/r", str(tmp_path / "state"))
    assert again.parts == done.parts


def test_refusal_ledger_over_runs(spark, tmp_path):
    schema = "connector string, slug string, code string, reason string, at timestamp, settled boolean"
    runs = [
        [("a", f"s{i}", "c", "r", f"2024-01-01 00:00:{i:02d}", False) for i in range(6)] + [("b", "x", "c", "r", "2024-01-01 00:00:00", False)],
        [("a", "s4", None, None, "2024-01-02 00:00:00", True), ("a", "s2", "d", "r", "2024-01-02 00:00:01", False), ("b", "x", None, None, "2024-01-02 00:00:00", True), ("b", "y", None, None, "2024-01-02 00:00:00", True)],
    ]
    out = None
    for k, run in enumerate(runs):
        spark.createDataFrame(run, "connector string, slug string, code string, reason string, at string, settled boolean").withColumn("at", F.to_timestamp("at")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        with LG.keyed_state(spark):
            stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
            out = W.drained(LG.refused_items(stream, most=4), str(tmp_path / "run"), "update").collect()
        version = {c: max(r.version for r in out if r.connector == c) for c in "ab"}
        now = [(r.connector, r.slug, r.code) for r in sorted(out, key=lambda r: (r.connector, r.place)) if r.version == version[r.connector] and r.place]
        assert now == ([("a", f"s{i}", "c") for i in range(2, 6)] + [("b", "x", "c")] if k == 0 else [("a", "s3", "c"), ("a", "s5", "c"), ("a", "s2", "d")])


def test_sweeps_read_only_what_changed(spark, tmp_path):
    root = tmp_path / "files"
    (root / ".git").mkdir(parents=True)
    for name, text in (("a.md", "one"), ("b.md", "two"), (".git/c.md", "no"), ("d.txt", "no"), ("e.md", "last"), ("empty.md", "")):
        (root / name).write_text(text)
    old = 1_700_000_000
    for name in ("a.md", "b.md", "e.md"):
        os.utime(root / name, (old, old))
    store = SW.file_store(spark, str(tmp_path / "store"), 4)
    SW.sweep(store, str(root), 1)
    held = lambda: {os.path.basename(r.path): (r.sweep, r.text) for r in store.rows().collect()}
    assert held() == {"a.md": (1, "one"), "b.md": (1, "two"), "e.md": (1, "last")}
    os.remove(root / "a.md")
    (root / "b.md").write_text("three")
    (root / "f.md").write_text("new")
    assert {(os.path.basename(r.path), r.kind) for r in SW.differences(SW.listed_files(spark, str(root), "*.md"), store.rows()).collect()} == {("a.md", "gone"), ("b.md", "changed"), ("f.md", "new")}
    SW.sweep(store, str(root), 2)
    assert held() == {"b.md": (2, "three"), "e.md": (1, "last"), "f.md": (2, "new")}
    (root / "g.md").write_text("moved in")
    os.utime(root / "g.md", (old - 5, old - 5))  # older than all that is indexed
    files = store.manifest().parts
    SW.sweep(store, str(root), 3)
    assert held()["g.md"] == (3, "moved in") and held()["e.md"] == (1, "last")
    same = SW.sweep(store, str(root), 4)
    assert same.generation == 4 and len(set(files.values()) & set(same.parts.values())) >= 2


def test_export_faults(spark, tmp_path):
    df = spark.range(100).select("id", F.concat(F.lit("t"), "id").alias("text"), (F.col("id") % 2).alias("side"))
    folder = str(tmp_path / "out")
    named = EX.export_rows(df, folder, "json", ["side"], 20)
    assert named.count() == 6 and named.agg(F.max("n")).first()[0] == 20
    assert EX.export_faults(spark, folder, df.schema, "json").collect() == []
    paths = sorted((tmp_path / "out/rows").rglob("part-*.json"))
    os.remove(paths[0])
    paths[1].write_text(paths[1].read_text().replace('"t', '"u', 1))
    for crc in (tmp_path / "out/rows").rglob(".*.crc"):
        os.remove(crc)
    (paths[2].parent / "part-extra.json").write_text('{"id":1}\n')
    assert sorted(r.fault for r in EX.export_faults(spark, folder, df.schema, "json").collect()) == ["changed", "missing", "unknown"]
    assert [tuple(r) for r in EX.same_rows(df, df.withColumn("text", F.upper("text"))).collect()] == [(100, 100, False)]
    with pytest.raises(Exception, match="already exists"):
        EX.export_rows(df, folder, "json")
