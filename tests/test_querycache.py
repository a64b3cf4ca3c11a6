"""The threshold join against every pair, and which cached answers are served."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import querycache as QC


@pytest.mark.parametrize(("similarity", "pivots"), [(0.92, 32), (0.5, 4), (0.0, 3), (0.99, 1)])
def test_near_vectors_equal_every_pair(spark, similarity, pivots):
    r = np.random.default_rng(3)
    centres = r.normal(size=(6, 8))
    stored = [(i, i % 2, [float(x) for x in centres[i % 6] + r.normal(size=8) * (0.02 + 0.5 * (i % 3))]) for i in range(240)]
    stored += [(300, 0, None), (301, 1, []), (302, 0, [0.0] * 8), (303, 1, [math.nan] * 8), (304, 0, [1.0, 2.0]), (305, None, [1.0] * 8), (306, 0, [5.0, None]), (307, 1, stored[1][2]), (308, 1, [2 * x for x in stored[1][2]])]
    asked = [(i, i % 2, [float(x) for x in centres[i % 6] + r.normal(size=8) * 0.3]) for i in range(60)] + [(70, 0, None), (71, 0, [2.0, 4.0]), (72, 1, stored[1][2]), (73, 1, stored[1][2]), (74, None, [1.0] * 8), (75, 0, [math.inf] * 8)]
    frame = lambda rows, key: spark.createDataFrame(rows, f"{key} int, bucket int, vector array<double>")
    got = {(x.query_id, x.key): x.similarity for x in QC.near_vectors(frame(asked, "query_id"), frame(stored, "key"), similarity, pivots).collect()}

    def cosine(a, b):
        if not a or not b or len(a) != len(b) or any(x is None or not math.isfinite(x) for x in [*a, *b]):
            return None
        lengths = math.hypot(*a) * math.hypot(*b)
        return sum(x * y for x, y in zip(a, b, strict=True)) / lengths if lengths else None

    want = {(q, k): c for q, b, a in asked for k, d, v in stored if b is not None and b == d and (c := cosine(a, v)) is not None}
    # a cosine on the threshold itself may fall to either side of it
    sure = {p for p, c in want.items() if c >= similarity + 1e-9}
    assert sure <= set(got) <= {p for p, c in want.items() if c >= similarity - 1e-9} and sure
    assert all(math.isclose(got[p], want[p], abs_tol=1e-9) for p in got)


def test_pivots_spare_most_pairs_of_clustered_vectors(spark):
    r = np.random.default_rng(5)
    centres = r.normal(size=(20, 16))
    rows = [(i, 0, [float(x) for x in centres[i % 20] + 0.05 * r.normal(size=16)]) for i in range(400)]
    frame = spark.createDataFrame(rows, "key int, bucket int, vector array<double>").select("bucket", QC.unit(F.col("vector")).alias("unit"))
    reach = math.acos(0.92)
    pivots = QC.pivots_of(frame)
    met = QC._placed(frame, pivots, reach, True).select("cell", "ring").join(QC._placed(frame, pivots, reach, False), ["cell", "ring"]).count()
    assert met < 0.3 * 400 * 400


def test_served_answers(spark):
    now = F.lit("2024-05-01 12:00:00").cast("timestamp")
    at = lambda minutes: f"2024-05-01 {11 - minutes // 60:02d}:{59 - minutes % 60:02d}:00"
    v, near, far = [1.0, 0.0], [0.99, 0.1], [0.6, 0.8]
    rows = [
        ("old_clock_same_docs", "b", near, 1, {"d1": 1}, at(5), ["r"]), ("changed", "b", v, 1, {"d1": 9}, at(5), ["r"]), ("gone", "b", v, 1, {"d1": 1, "nope": 1}, at(5), ["r"]),
        ("no_docs", "b", v, 1, {}, at(5), ["r"]), ("too_old", "b", v, 2, {}, at(61), ["r"]), ("other_bucket", "c", v, 2, {}, at(5), ["r"]), ("far", "b", far, 2, {}, at(5), ["r"]), ("timeless", "b", v, 2, {}, None, ["r"]),
        ("empty", "d", v, 2, {}, at(5), []), ("null_clock", "b", v, None, None, at(5), ["r"]),
    ]
    cache = spark.createDataFrame(rows, "key string, bucket string, vector array<double>, clock int, doc_generations map<string,long>, stored_at string, result_ids array<string>").withColumns({"stored_at": F.to_timestamp("stored_at"), "intent": F.lit("i")})
    documents = spark.createDataFrame([("d1", 1), ("d2", 5)], "document_id string, generation long")
    fresh = {r.key for r in QC.pruned(cache, documents, 2).collect()}
    assert fresh == {"old_clock_same_docs", "too_old", "other_bucket", "far", "timeless", "empty"}
    asked = spark.createDataFrame([(1, "b", v), (2, "c", v), (3, "d", v), (4, "b", [-1.0, 0.0])], "query_id int, bucket string, vector array<double>")
    assert {(r.query_id, r.key) for r in QC.semantic_hits(asked, cache, documents, 2, now).collect()} == {(1, "old_clock_same_docs"), (2, "other_bucket")}
    keys = spark.createDataFrame([("empty",), ("far",), ("changed",), ("far",)], "key string")
    assert [r.key for r in QC.exact_hits(keys, cache, documents, 2).collect()] == ["far"]


def test_no_key_of_a_meeting_holds_a_whole_bucket(spark, tmp_path):
    """All blocks of a bucket were joined by bucket and width alone, so one task held them."""
    import re
    from collections import Counter

    import numpy as np

    from tessera.operators import tiles

    rng = np.random.default_rng(5)
    units = rng.normal(size=(300, 4))
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    rows = spark.createDataFrame([("b", i, u.tolist(), []) for i, u in enumerate(units)], "bucket string, key int, unit array<double>, angles array<double>")
    blocks = tiles.blocks(rows, [], rows_a_block=5)
    met = tiles.meetings(blocks, blocks, lambda products: np.nonzero(products >= 0.9), part_blocks=4)
    expected = {(i, j) for i, j in zip(*np.nonzero(units @ units.T >= 0.9), strict=True)}
    got = Counter((r.query_id, r.key) for r in met.select("query_id", "key").collect())
    assert set(got) == expected and max(got.values()) == 1
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Join Inner, .*asked_part.*stored_part", plan)
