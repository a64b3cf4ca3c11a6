"""Retrieval evaluation: runs against judgements, comparison with a baseline, bootstrap intervals."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import stats as M
from tessera.operators.graph import reliable_checkpoint

ITERATIONS, SEED = 2000, 42
#: Values in a block, parts into which the iterations are dealt, and picks that are held at once.
BLOCK, TILES, PICKS = 1 << 21, 48, 1 << 18


def uniform(seed: int, n: int, skip: int = 0) -> np.ndarray:
    """The n numbers of the 32-bit mulberry generator after the first ``skip``; its state advances by a constant, modulo 2^32."""
    a = np.uint32(seed) + (np.arange(1, n + 1, dtype=np.uint32) + np.uint32(skip % 2**32)) * np.uint32(0x6D2B79F5)
    t = (a ^ (a >> np.uint32(15))) * (a | np.uint32(1))
    t ^= t + (t ^ (t >> np.uint32(7))) * (t | np.uint32(61))
    return (t ^ (t >> np.uint32(14))) / 4294967296.0


def mean_interval(values: np.ndarray, iterations: int = ITERATIONS, seed: int = SEED, alpha: float = 0.05) -> tuple[float, float, float]:
    """Mean and percentile bootstrap interval; the mean itself where all values are equal, zeros where there are none."""
    n = len(values)
    if n == 0:
        return 0.0, 0.0, 0.0
    mean = float(values.mean())
    if (values == values[0]).all():
        return mean, mean, mean
    picks = (uniform(seed, iterations * n) * n).astype(np.int64).reshape(iterations, n)
    means = np.sort(values[picks].mean(axis=1))
    lo = means[min(iterations - 1, max(0, int(np.floor(alpha / 2 * iterations))))]
    hi = means[min(iterations - 1, max(0, int(np.ceil((1 - alpha / 2) * iterations)) - 1))]
    return mean, min(float(lo), mean), max(float(hi), mean)


def tile_sums(values: pd.DataFrame, n: int, iterations: int = ITERATIONS, seed: int = SEED, tiles: int = TILES) -> pd.DataFrame:
    """(iteration, total) of one tile: over the picks of its iterations that fall on ``values`` (tile, at, d), which lie in a row from the least ``at``, their sum."""
    tile, first = int(values["tile"].iloc[0]), int(values["at"].min())
    d = values.sort_values("at")["d"].to_numpy(dtype=float)
    mine = np.arange(tile, iterations, tiles)
    totals = np.zeros(len(mine))
    for k, i in enumerate(mine):
        for begin in range(0, n, PICKS):
            picks = (uniform(seed, min(PICKS, n - begin), int(i) * n + begin) * n).astype(np.int64) - first
            totals[k] += d[picks[(picks >= 0) & (picks < len(d))]].sum()
    return pd.DataFrame({"iteration": mine, "total": totals})


def numbered(rows: DataFrame, order: str) -> DataFrame:
    """``rows`` with ``at``, their places from 0 in ``order``: ranges are sorted apart and begin where the rows of the ranges before end."""
    part = reliable_checkpoint(rows.repartitionByRange(order).sortWithinPartitions(order).withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}))
    of_part = part.groupBy("_part").agg(F.count("*").alias("n"), F.min("_row").alias("_first"))
    begins = of_part.withColumn("_before", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row a partition
    return part.join(F.broadcast(begins), "_part").withColumn("at", F.col("_row") - F.col("_first") + F.col("_before")).drop("_part", "_row", "_first", "_before", "n")


def paired_interval(deltas: DataFrame, block: int = BLOCK, iterations: int = ITERATIONS, seed: int = SEED, alpha: float = 0.05) -> DataFrame:
    """(queries, delta, lo, hi): ``mean_interval`` of all ``deltas`` (query_id, d) in the order of their queries, over blocks of values and tiles of iterations.

    A task holds one block of values and ``PICKS`` picks at a time; the picks are those of the plain version. The sums of all iterations are ``iterations`` rows.
    """
    placed = numbered(deltas, "query_id")
    facts = placed.agg(F.count("*").alias("queries"), F.avg("d").alias("delta"), F.min("d").alias("least"), F.max("d").alias("most")).first()
    n, mean = facts["queries"], facts["delta"]
    if not n or facts["least"] == facts["most"]:
        mean = facts["least"] if n else 0.0
        return deltas.sparkSession.createDataFrame([(n, mean, mean, mean)], "queries long, delta double, lo double, hi double")
    tiled = placed.select(F.floor(F.col("at") / block).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(TILES - 1))).alias("tile"), "at", "d")
    sums = tiled.groupBy("block", "tile").applyInPandas(lambda values: tile_sums(values, n, iterations, seed), "iteration long, total double")
    means = F.sort_array(F.collect_list("mean"))
    found = sums.groupBy("iteration").agg((F.sum("total") / n).alias("mean")).agg(means.alias("m"))
    at = lambda i: F.get("m", F.lit(min(iterations - 1, max(0, int(i)))))
    lo, hi = at(np.floor(alpha / 2 * iterations)), at(np.ceil((1 - alpha / 2) * iterations) - 1)
    return found.select(F.lit(n).cast("long").alias("queries"), F.lit(mean).alias("delta"), F.least(lo, F.lit(mean)).alias("lo"), F.greatest(hi, F.lit(mean)).alias("hi"))


def run(hits: DataFrame, judgements: DataFrame, k: int) -> DataFrame:
    """Metrics of each judged query (query_id, relevant); ``hits``: query_id, id, rank. Queries without hits score 0."""
    ranked = hits.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("ranked"))
    both = judgements.join(ranked, "query_id", "left").withColumn("ranked", F.coalesce("ranked", F.array().cast(ranked.schema["ranked"].dataType)))
    r, rel = F.col("ranked"), F.col("relevant")
    return both.select("query_id", M.precision_at(r, rel, k).alias("precision"), M.recall_at(r, rel, k).alias("recall"), M.reciprocal_rank(r, rel).alias("rr"), M.ndcg_at(r, rel, k).alias("ndcg"))


def summary(metrics: DataFrame, least_recall: float = 0.6) -> DataFrame:
    """Means over queries, and whether the recall gate holds."""
    return metrics.agg(F.count("*").alias("queries"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("rr").alias("mrr"), F.avg("ndcg").alias("ndcg"), (F.avg("recall") >= least_recall).alias("passes"))


def compare(now: DataFrame, before: DataFrame, metric: str = "ndcg", allowed_drop: float = 0.02) -> DataFrame:
    """Paired difference of a metric over common queries with its bootstrap interval; fails if the whole interval lies below the allowed drop."""
    pairs = now.select("query_id", F.col(metric).alias("a")).join(before.select("query_id", F.col(metric).alias("b")), "query_id")
    return paired_interval(pairs.select("query_id", (F.col("a") - F.col("b")).alias("d"))).withColumn("passes", F.col("hi") >= -allowed_drop)


def push_metrics(turns: DataFrame) -> DataFrame:
    """Precision, recall, miss and false-fire rates of volunteered ids per turn (volunteered, gold, acceptable arrays)."""
    hit = F.size(F.array_intersect("volunteered", "gold"))
    fine = F.size(F.array_intersect("volunteered", F.array_union("gold", "acceptable")))
    s = lambda c: F.sum(c)
    return turns.agg((s(fine) / F.nullif(s(F.size("volunteered")), F.lit(0))).alias("precision"), (s(hit) / F.nullif(s(F.size("gold")), F.lit(0))).alias("recall"),
                     (F.count_if((F.size("gold") > 0) & (hit == 0)) / F.nullif(F.count_if(F.size("gold") > 0), F.lit(0))).alias("miss_rate"), (F.count_if((F.size("gold") == 0) & (F.size("volunteered") > 0)) / F.nullif(F.count_if(F.size("gold") == 0), F.lit(0))).alias("false_fire_rate"))


def fidelity(extracted: DataFrame, gold: DataFrame) -> DataFrame:
    """Precision and recall of extracted facts (entity_slug, fact) on normalised text."""
    norm = F.lower(F.trim(F.regexp_replace("fact", r"[^\p{L}\p{N}]+", " "))).alias("f")
    e, g = extracted.select("entity_slug", norm).distinct().withColumn("e", F.lit(1)), gold.select("entity_slug", norm).distinct().withColumn("g", F.lit(1))
    both = e.join(g, ["entity_slug", "f"], "full_outer")
    right = F.count_if(F.col("e").isNotNull() & F.col("g").isNotNull())
    return both.agg((right / F.nullif(F.count("e"), F.lit(0))).alias("precision"), (right / F.nullif(F.count("g"), F.lit(0))).alias("recall"))
