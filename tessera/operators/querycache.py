"""The query cache: which entries may still be served, the nearest one to a question, and pruning.

Nearest entries come from an exact threshold join of unit vectors. Angles between them obey the triangle inequality: an entry lies in the
cell of its nearest pivot, in a ring as wide as the threshold's angle, and so does a question. Those of a cell form blocks; two blocks are refused
where their angles to any pivot lie farther apart than the threshold's angle, and else multiplied out, one matrix product each. Pivots only save work; they
change no result.

Defined results: null, empty, zero and non-finite vectors are near nothing; vectors of unequal length are not near each other; equal similarities go
to the lesser key; a null bucket is in no bucket; an entry without a time is too old.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import tiles
from tessera.operators.graph import reliable_checkpoint

# fixed values: least similarity, and seconds that an entry may be served by it
SIMILARITY, TTL_SECONDS = 0.92, 3600
PIVOTS = 32
#: Slack for rounding of angles.
SLACK = 1e-6


def unit(vector: Column) -> Column:
    """The vector at length 1; null where it has none."""
    whole = F.col("vector") if isinstance(vector, str) else vector
    whole = whole.cast("array<double>")
    length = F.sqrt(F.aggregate(whole, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.when((length > 0) & (length < F.lit(math.inf)), F.transform(whole, lambda x: x / length))


def pivots_of(vectors: DataFrame, n: int = PIVOTS) -> dict[int, np.ndarray]:
    """At most ``n`` unit vectors (unit) of each of the eight most frequent lengths, by length."""
    # those of least hash, found by hashes alone: two vectors of one hash would only be one pivot less
    hashes = vectors.select(F.size("unit").alias("d"), F.xxhash64("unit").alias("h"))
    widths = hashes.groupBy("d").count().orderBy(F.desc("count"), "d").limit(8)
    least = Window.partitionBy("d").orderBy("h")
    chosen = hashes.join(F.broadcast(widths.select("d")), "d").distinct().withColumn("_n", F.row_number().over(least)).where(F.col("_n") <= n)
    some = vectors.select("unit", F.size("unit").alias("d"), F.xxhash64("unit").alias("h")).join(F.broadcast(chosen), ["d", "h"]).groupBy("d", "_n").agg(F.min("unit").alias("unit"))
    out: dict[int, list[list[float]]] = {}
    for r in some.orderBy("d", "_n").collect():  # at most eight times ``n``
        out.setdefault(r["d"], []).append(r["unit"])
    return {d: np.array(v) for d, v in out.items()}


def _placed(vectors: DataFrame, pivots: dict[int, np.ndarray], reach: float, probing: bool) -> DataFrame:
    """``vectors`` (with unit) with their angles to the pivots and the (cell, ring) they lie in, or, if ``probing``, all that they may find a neighbour in."""
    added = [T.StructField("angles", T.ArrayType(T.DoubleType())), T.StructField("cell", T.IntegerType()), T.StructField("ring", T.IntegerType())]
    schema = T.StructType([*vectors.schema.fields, *added])
    at = vectors.columns.index("unit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, angles, cells, rings = [], [], [], []
            for i, u in enumerate(batch.column(at).to_pylist()):
                p = pivots.get(len(u))
                a = np.arccos(np.clip(p @ np.array(u), -1.0, 1.0)) if p is not None else np.zeros(0)
                if not len(a):
                    found = [(-len(u) - 1, 0)]  # no pivot has this length: such vectors meet in one cell
                elif probing:
                    near = np.flatnonzero(a <= a.min() + 2 * reach + SLACK)
                    found = [(int(c), int(r)) for c in near for r in range(int(max(a[c] - reach - SLACK, 0) // reach), int((a[c] + reach + SLACK) // reach) + 1)]
                else:
                    found = [(int(a.argmin()), int(a.min() // reach))]
                rows += [i] * len(found)
                angles += [a.tolist()] * len(found)
                cells += [c for c, _ in found]
                rings += [r for _, r in found]
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(rows, pa.int64())) for c in batch.columns), pa.array(angles, pa.list_(pa.float64())), pa.array(cells, pa.int32()), pa.array(rings, pa.int32())], names=schema.names)

    return vectors.mapInArrow(run, schema)


def near_vectors(asked: DataFrame, stored: DataFrame, similarity: float, n_pivots: int = PIVOTS) -> DataFrame:
    """(query_id, key, similarity): all pairs of ``asked`` (query_id, bucket, vector) and ``stored`` (key, bucket, vector) of the same bucket whose cosine is
    at least ``similarity``, which is greater than -1."""
    reach = max(math.acos(similarity), 1e-3) + SLACK
    query, entry = (d.select("bucket", F.col(key).alias("key"), unit(F.col("vector")).alias("unit")).where("unit IS NOT NULL AND bucket IS NOT NULL") for d, key in ((asked, "query_id"), (stored, "key")))
    pivots = pivots_of(entry, n_pivots)
    one, two = (reliable_checkpoint(tiles.blocks(_placed(d, pivots, reach, False), ["cell"])) for d in (query, entry))
    # two blocks whose angles to some pivot lie farther apart than the threshold's hold no pair
    apart = F.exists(F.arrays_zip("low", "high", "asked_low", "asked_high"), lambda x: F.greatest(x["low"] - x["asked_high"], x["asked_low"] - x["high"]) > reach + SLACK)
    return tiles.meetings(one, two, lambda products: np.nonzero(products >= similarity), ~apart)


def with_freshness(cache: DataFrame, documents: DataFrame, clock: int) -> DataFrame:
    """``cache`` (key, clock, doc_generations map and others) with ``fresh``: it was written at this ``clock``, or it names documents and all of them
    (document_id, generation) are there and as they were."""
    seen = cache.where(F.col("clock").isNull() | (F.col("clock") != clock)).select("key", F.explode("doc_generations").alias("document_id", "seen"))
    now = seen.join(documents.select("document_id", "generation"), "document_id", "left")
    unchanged = now.groupBy("key").agg(F.bool_and(F.coalesce(F.col("generation") == F.col("seen"), F.lit(False))).alias("_unchanged"))
    return cache.join(unchanged, "key", "left").withColumn("fresh", F.coalesce(F.col("clock") == clock, F.lit(False)) | F.coalesce("_unchanged", F.lit(False))).drop("_unchanged")


def semantic_hits(
    asked: DataFrame, cache: DataFrame, documents: DataFrame, clock: int, now: Column, similarity: float = SIMILARITY, ttl_seconds: int = TTL_SECONDS
) -> DataFrame:
    """(query_id, key, similarity, intent, result_ids): for each question (query_id, bucket, vector) the nearest entry of its bucket that is nearer than
    ``similarity``, young and fresh, if it has results. ``cache`` has key, bucket, vector, clock, doc_generations, stored_at, intent and result_ids."""
    young = cache.where(F.col("vector").isNotNull() & (F.unix_micros("stored_at") > F.unix_micros(now) - ttl_seconds * 1_000_000))
    served = with_freshness(young, documents, clock).where("fresh")
    nearest = Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 9)), "key")
    best = near_vectors(asked, served, similarity).where(F.col("similarity") > similarity).withColumn("_n", F.row_number().over(nearest)).where("_n = 1").drop("_n")
    return best.join(served.select("key", "intent", "result_ids"), "key").where(F.size("result_ids") > 0).select("query_id", "key", "similarity", "intent", "result_ids")


def exact_hits(asked: DataFrame, cache: DataFrame, documents: DataFrame, clock: int) -> DataFrame:
    """(key, intent, result_ids): the fresh entries with results among the keys that are asked for."""
    found = cache.join(asked.select("key").distinct(), "key", "left_semi").where(F.size("result_ids") > 0)
    return with_freshness(found, documents, clock).where("fresh").select("key", "intent", "result_ids")


def pruned(cache: DataFrame, documents: DataFrame, clock: int) -> DataFrame:
    """The entries that can still be served."""
    return with_freshness(cache, documents, clock).where("fresh").drop("fresh")
