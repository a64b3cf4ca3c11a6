"""Closed-form statistics and retrieval metrics as column expressions over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def wilson(hits: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Lower and upper bound of a proportion; exact 0 and 1 at the ends, null without trials."""
    p = hits / n
    centre, spread, scale = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    low = F.when(n == 0, None).when(hits == 0, 0.0).otherwise(F.greatest(F.lit(0.0), (centre - spread) / scale))
    high = F.when(n == 0, None).when(hits == n, 1.0).otherwise(F.least(F.lit(1.0), (centre + spread) / scale))
    return low, high


def top(ranked: Column, k: int) -> Column:
    """The first k distinct ids of a ranking."""
    return F.slice(F.array_distinct(ranked), 1, k)


def precision_at(ranked: Column, relevant: Column, k: int) -> Column:
    return F.size(F.array_intersect(top(ranked, k), relevant)) / k


def recall_at(ranked: Column, relevant: Column, k: int) -> Column:
    n = F.size(F.array_distinct(relevant))
    return F.when(n == 0, 0.0).otherwise(F.size(F.array_intersect(top(ranked, k), relevant)) / n)


def reciprocal_rank(ranked: Column, relevant: Column) -> Column:
    flags = F.transform(F.array_distinct(ranked), lambda x: F.array_contains(relevant, x))
    first = F.array_position(flags, F.lit(True))
    return F.when(first > 0, 1 / first).otherwise(0.0)


def dcg(flags: Column) -> Column:
    gains = F.transform(flags, lambda g, i: g / F.log2(i + 2.0))
    return F.aggregate(gains, F.lit(0.0), lambda acc, x: acc + x)


def ndcg_at(ranked: Column, relevant: Column, k: int) -> Column:
    """Binary-gain nDCG over the first k distinct ids."""
    flags = F.transform(top(ranked, k), lambda x: F.when(F.array_contains(relevant, x), 1.0).otherwise(0.0))
    ideal = F.transform(F.sequence(F.lit(1), F.greatest(F.least(F.size(F.array_distinct(relevant)), F.lit(k)), F.lit(1))), lambda i: F.lit(1.0))
    return F.when(F.size(relevant) == 0, 0.0).otherwise(dcg(flags) / dcg(ideal))


def jaccard_at(a: Column, b: Column, k: int) -> Column:
    x, y = top(a, k), top(b, k)
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / union)


def brier(weight: Column, outcome: Column) -> Column:
    """Aggregate: mean squared error over rows with an outcome."""
    return F.avg(F.when(outcome.isNotNull(), F.pow(weight - outcome, 2)))


def backoff_seconds(attempts: Column) -> Column:
    return F.least(5.0 * F.pow(F.lit(2.0), F.least(attempts, F.lit(30))), F.lit(1800.0))
