"""Resampling, hard negatives and sum-of-squares packing against plain versions and defined edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import bin_packing, hard_negatives, langid, packing, queries, resampling, tokens

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, row long, feature string, gain double, n string, place int"


def plain_features(text, max_n):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(w), [" ".join(w[i : i + n]) for n in range(1, max_n + 1) for i in range(len(w) - n + 1)]


def plain_resample(docs, target, max_n, buckets, min_words, percent):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for _, x in rows for f in plain_features(x, max_n)[1]) for rows in (docs, target))
    total_s, total_t = sum(s.values()), sum(t.values())
    out = []
    for i, x in docs:
        n, fs = plain_features(x, max_n)
        gains = [math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets)))) for b in map(bucket, fs)]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in out if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = {id(r): k + 1 for k, r in enumerate(able[: len(able) * percent // 100])}
    return sorted(((r[0], r[1], r[2], r[3], ranks.get(id(r)), r[4]) for r in out), key=str)


def odd_docs(n=150):
    r = random.Random(4)
    vocabulary = ["".join(r.choices("abcdeéß9", k=r.randint(1, 6))) for _ in range(80)]
    rows = [(i, " ".join(r.choices(vocabulary, k=r.randint(0, 60)))) for i in range(n)]
    rows += [(n, None), (n + 1, ""), (n + 2, "...\x00!"), (None, rows[0][1] + " A-b"), (7, "ÀB cd e 日本"), (3, "x" * 200_000 + " " + " ".join(vocabulary * 300))] + [(5, rows[5][1])] * 4
    return rows


def as_docs(spark, rows):
    return spark.createDataFrame([(i, t, "l", 1, "f", 0.5, "n", 2) for i, t in rows], DOCS)


@pytest.mark.parametrize(("max_n", "frequent"), [(1, 1000), (1, 0), (2, 20), (3, 5)])
def test_resampling_equals_a_plain_version(spark, max_n, frequent):
    rows = odd_docs()
    target = rows[10:25] + [(0, None), (1, "only here")]
    got = resampling.resample(as_docs(spark, rows), spark.createDataFrame(target, "item_id long, text string"), max_n, 50, 20, 30, frequent=frequent)
    assert sorted(map(tuple, got.collect()), key=str) == plain_resample(rows, target, max_n, 50, 20, 30)


def test_resampling_of_nothing(spark):
    docs, none = as_docs(spark, odd_docs(30)), as_docs(spark, [])
    assert resampling.resample(none, docs).collect() == []
    assert {(r.doc_id, r.weight) for r in resampling.resample(docs.where("doc_id > 1000"), none).collect()} == set()
    got = resampling.resample(docs, none.select("text"), percent=100).collect()
    assert sorted(r.rank for r in got if r.n_words >= 20) == list(range(1, 1 + sum(r.n_words >= 20 for r in got)))


def test_resampling_prefers_the_target(spark):
    r = random.Random(6)
    rows = [(i, " ".join(r.choices(["north", "south", "east"] if i % 4 == 0 else ["up", "down", "left"], k=40))) for i in range(400)]
    got = resampling.resample(as_docs(spark, rows), spark.createDataFrame([(0, "north south east " * 30)], "item_id long, text string"), percent=20).where("rank IS NOT NULL").collect()
    assert len(got) == 80 and sum(x.doc_id % 4 == 0 for x in got) > 60


def plain_mine(rows, positives=5, negatives=10, low=30, high=90, scale=256, every=100):
    def whole(v):
        return None if v is None or any(x is None or not math.isfinite(x) for x in v) else [math.floor(scale * x) for x in v]

    able = [(i, l, w) for i, l, v in rows if i is not None and l is not None and (w := whole(v)) is not None]
    hold = lambda x: min(max(x, -(2**63)), 2**63 - 1)
    dot = lambda a, b: hold(sum(x * y for x, y in zip(a, b, strict=False)))
    out = []
    for i, l, v in sorted({(i, l, tuple(v)) for i, l, v in able if i % every == 0}):
        near = sorted((-dot(v, w), j) for j, m, w in able if m == l and j != i)[:positives]
        for k, (p, j) in enumerate(near):
            far = sorted((-s, x) for x, m, w in able if m != l and low * -p <= 100 * (s := dot(v, w)) <= high * -p)[:negatives]
            out += [(i, j, r + 1, x, -p, -s, k + 1) for r, (s, x) in enumerate(far)]
    return sorted(out)


def vectors(n=600, seed=5):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(4, 12))
    rows = [(int(i), int(i % 4), [float(np.float32(x)) for x in centres[i % 4] * 0.4 + centres.mean(axis=0) + r.normal(size=12) * (1 + (i % 3))]) for i in range(n)]
    rows += [(700, 1, None), (800, None, [0.1] * 12), (None, 2, [0.2] * 12), (900, 1, [0.1, None]), (901, 1, [float("nan")] * 3), (902, 2, [float("inf")]), (1000, 2, []), (1001, 2, [0.5, 0.25]), (1002, 3, [])]
    return rows + [rows[100]] * 2 + [rows[8]] * 3 + [(9, 3, rows[9][2])] * 2


@pytest.mark.parametrize("at_once", [4096, 2])
def test_hard_negatives_equal_a_plain_version(spark, at_once):
    rows = vectors()
    df = spark.createDataFrame([(*x, "a", 1) for x in rows], "vec_id long, label int, embedding array<float>, id string, score int")
    got = hard_negatives.mine(df, F.col("vec_id") % 100 == 0, anchors_at_once=at_once)
    assert sorted(map(tuple, got.collect())) == plain_mine(rows) != []
    assert hard_negatives.mine(df.limit(0), F.col("vec_id") % 100 == 0).collect() == []
    assert hard_negatives.mine(df.where("vec_id = 100"), F.col("vec_id") % 100 == 0).collect() == []


def test_hard_negatives_of_ties_and_large_components(spark):
    r = random.Random(8)
    ties = [(i, i % 3, [float(r.choice([0, 1, 2])) for _ in range(5)]) for i in range(300)]
    large = [(i, i % 2, [r.choice([1.0, 2.0, -1.0, 3.5]) * 10.0 ** r.choice([0, 3, 9, 30, 200]) for _ in range(6)]) for i in range(200)]
    for rows in (ties, large):
        df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
        assert sorted(map(tuple, hard_negatives.mine(df, F.col("vec_id") % 50 == 0).collect())) == plain_mine(rows, every=50)


def test_far_pairs_are_discarded_early():
    r = np.random.default_rng(2)
    rows = np.floor(256 * r.normal(size=(2000, 64)) * np.linspace(3, 0.1, 64))
    rotation = hard_negatives.Rotation(rows.T @ rows, 64)
    block = hard_negatives.Anchors(np.arange(20), np.zeros(20, dtype=int), rows[:20], rotation)
    exact = rows @ rows[:20].T
    low, high = np.sort(exact, axis=0)[-8].astype(np.int64), np.full(20, hard_negatives.LONG.max)
    seen = []
    verify, hard_negatives.products = hard_negatives.products, lambda *a: seen.append(len(a[2])) or verify(*a)
    try:
        i, j, s = block.survivors(rows, *rotation.turned(rows), np.arange(20), low, high)
    finally:
        hard_negatives.products = verify
    assert set(zip(i, j, s, strict=True)) == {(a, b, exact[a, b]) for a, b in zip(*np.nonzero(exact >= low), strict=True)}
    assert sum(seen) < 0.02 * exact.size


def plain_sum_of_squares(histogram, capacity):
    """Each choice tried in full, sums recomputed; returns the number of sequences."""
    left = sorted(Counter(histogram).elements(), reverse=True)
    needed, gaps, full = -(-sum(left) // capacity), [], 0
    for x in left:
        if x == capacity:
            full += 1
            continue
        choices = []
        for g in sorted({g for g in gaps if g >= x}) + ([capacity] if len(gaps) + full < needed or not any(g >= x for g in gaps) else []):
            after = list(gaps)
            if g < capacity:
                after.remove(g)
            after.append(g - x)
            choices.append((sum(n * n for k, n in Counter(after).items() if k), g))
        g = min(choices)[1]
        if g < capacity:
            gaps.remove(g)
        gaps.append(g - x)
        full, gaps = full + sum(k == 0 for k in gaps), [k for k in gaps if k]
    return full + len(gaps), Counter(gaps)


@pytest.mark.parametrize("seed", range(6))
def test_sum_of_squares_equals_a_plain_version(seed):
    r = random.Random(seed)
    histogram = {r.randint(1, 40): r.randint(1, 9) for _ in range(25)} | ({40: 3} if seed % 2 else {})
    patterns = bin_packing.sum_of_squares(histogram, 40)
    placed = Counter()
    for pattern, count in patterns:
        assert sum(pattern) <= 40 and count > 0
        for length in pattern:
            placed[length] += count
    assert placed == Counter(histogram)
    gaps = Counter()
    for pattern, count in patterns:
        gaps[40 - sum(pattern)] += count
    gaps.pop(0, None)
    assert (sum(c for _, c in patterns), gaps) == plain_sum_of_squares(histogram, 40)


def test_sum_of_squares_in_units():
    r = random.Random(9)
    histogram = {length: r.randint(1, 10**7) for length in r.sample(range(1, 4097), 900)}
    patterns = bin_packing.sum_of_squares(histogram)
    placed = Counter()
    for pattern, count in patterns:
        assert sum(pattern) <= 4096
        for length in pattern:
            placed[length] += count
    assert placed == Counter(histogram) and bin_packing.sum_of_squares({}) == []
    # as good as one by one on a thousandth of the pieces
    some = {length: max(1, n // 50_000) for length, n in histogram.items()}
    filled = [sum(c for _, c in p) * 4096 / sum(k * v for k, v in h.items()) for p, h in ((patterns, histogram), (bin_packing.sum_of_squares(some), some))]
    assert filled[0] < filled[1] + 0.001 < 1.02 and len(patterns) < 200_000


def test_whole_documents_are_packed(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(10**6, None, "x"), (10**6, None, "x"), (10**6 + 1, "", "x"), (None, "hello there", "x"), (10**6 + 2, "word " * 9000, "x")]
    docs = docs.select("doc_id", "text", F.lit("x").alias("start")).union(spark.createDataFrame(odd, "doc_id long, text string, start string"))
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokens.default_tokenizer_path())
    want = sorted(((-1 if d.doc_id is None else d.doc_id), tokenizer.encode(d.text or "", add_special_tokens=False).ids + [1]) for d in docs.collect())
    got = bin_packing.pack_whole(docs).collect()
    pieces = sorted(((-1 if p.doc_id is None else p.doc_id), p.piece, p.start, p.length, p.ids_crc32) for p in got)
    expected = [(i, k // 4096, k, len(x[k : k + 4096]), zlib.crc32(np.array(x[k : k + 4096], dtype="<u4").tobytes())) for i, x in want for k in range(0, len(x), 4096)]
    assert pieces == sorted(expected)
    sequences = {}
    for p in got:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(p.length for p in got)
    assert len(sequences) <= -(-total // 4096) + 1
    assert bin_packing.pack_whole(docs.limit(0)).collect() == []
    assert packing.packed_ids(docs, capacity=4096, plan_for=bin_packing.sum_of_squares).agg(F.sum("length")).first()[0] == total


@pytest.mark.parametrize("name", ["op11_importance_resampling", "op12_hard_negatives"])
def test_registered_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cursor = con.execute(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, SF)
    columns = [c[0] for c in cursor.description]
    assert sorted(map(str, map(tuple, got.select(columns).collect()))) == sorted(map(str, cursor.fetchall()))


def test_texts_of_no_known_language_are_rejected(spark):
    """Random letters and scripts without labels go; labelled texts stay, also those of a script of thousands of signs."""
    r = random.Random(12)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    han = [chr(0x4E00 + i) for i in range(3000)]
    words = ["".join(r.choices(han, k=r.randint(1, 3))) for _ in range(400)]
    chinese = [(10**6 + i, "".join(r.choices(words, k=150)), "zh") for i in range(150)]
    letters = "abcdefghijklmnopqrstuvwxyz"
    junk = [(2 * 10**6 + i, " ".join("".join(r.choices(letters, k=r.randint(2, 9))) for _ in range(r.choice([30, 100, 400]))), None) for i in range(60)]
    junk += [(3 * 10**6 + i, " ".join("".join(r.choices("абвгдежзиклмнопрстуфхцчшщыьэюя", k=r.randint(2, 9))) for _ in range(r.choice([2, 10, 100]))), None) for i in range(40)]
    junk += [(4 * 10**6 + i, "".join(r.choices([chr(0xAC00 + k) for k in range(5000)], k=80)), None) for i in range(20)]
    mixed = docs.union(spark.createDataFrame([*chinese, *junk], "doc_id long, text string, lang string"))
    kept = {x.doc_id for x in langid.in_known_language(mixed).select("doc_id").collect()}
    clean = [x.doc_id for x in docs.where("lang IS NOT NULL AND text rlike '\\\\p{L}'").collect()]
    assert sum(i in kept for i in clean) >= 0.995 * len(clean)
    assert sum(i in kept for i, _, _ in chinese) >= 0.97 * len(chinese)
    assert sum(i in kept for i, _, _ in junk) <= 0.05 * len(junk)
    found = langid.identify(mixed).where("doc_id >= 1000000 AND doc_id < 2000000").collect()
    assert {x.lang_pred for x in found} == {"zh"} and all(x.known and x.score > 0.9 for x in found)
    assert all(x.score <= 0.01 for x in langid.identify(mixed).where("NOT known").collect())
