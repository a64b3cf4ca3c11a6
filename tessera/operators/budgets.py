"""What fits: recall and context packs under token budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def prefix_within(rows: DataFrame, by: str, order: list, cost: str, budget: object) -> DataFrame:
    """For each group the longest prefix in order whose summed cost is within the budget (a number or a column)."""
    spent = F.sum(cost).over(Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_spent", spent).where(F.col("_spent") <= budget)


def recall(facts: DataFrame, timeline: DataFrame, pages: DataFrame, budget: int) -> DataFrame:
    """(entity, arm, id, cost): half the budget for facts, a fifth for the timeline; the page body takes what is left, cut to fit.

    Rows: facts and timeline (entity, id, cost, place), pages (entity, body).
    """
    f = prefix_within(facts, "entity", ["place", "id"], "cost", budget * 0.5).select("entity", F.lit("fact").alias("arm"), "id", "cost")
    t = prefix_within(timeline, "entity", ["place", "id"], "cost", budget * 0.2).select("entity", F.lit("timeline").alias("arm"), "id", "cost")
    used = f.unionByName(t).groupBy("entity").agg(F.sum("cost").alias("used"))
    left = F.lit(budget) - F.coalesce("used", F.lit(0))
    p = pages.join(used, "entity", "left").select("entity", F.lit("page").alias("arm"), F.lit(0).cast("long").alias("id"), F.least(left, F.ceil(F.length("body") / 4)).cast("long").alias("cost"))
    return f.unionByName(t).unionByName(p.where("cost > 0"))


def context_pack(cards: DataFrame, budget: int, gate: float = 0.7) -> DataFrame:
    """Cards (query_id, slug, explicit, salience, cost): the named ones first, then salient ones, as far as they fit."""
    wanted = cards.where(F.col("explicit") | (F.col("salience") >= gate))
    return prefix_within(wanted, "query_id", [F.desc("explicit"), F.desc("salience"), F.asc("slug")], "cost", budget).drop("_spent")
