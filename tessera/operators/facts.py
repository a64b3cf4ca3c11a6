"""Bitemporal facts and ontologies: keys, decay, supersession, as-of reads, conflicts, consolidation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.rank import age_days, fact_confidence
from tessera.functions.text import claim_key
from tessera.functions.vector import norm
from tessera.operators import tiles


def live(facts: DataFrame) -> DataFrame:
    return facts.where(F.col("forgotten_at").isNull())


def in_scope(df: DataFrame, scope: list[str] | None, col: str = "source_id") -> DataFrame:
    """No scope reads everything, an empty one nothing; a null source is in no list."""
    return df if scope is None else df.where(F.col(col).isin(scope)) if scope else df.where(F.lit(False))


def decayed(facts: DataFrame, now: Column) -> DataFrame:
    """Facts with their confidence at ``now``."""
    expired = F.col("valid_until").isNotNull() & (F.col("valid_until") < F.to_date(now))
    return facts.withColumn("confidence_now", fact_confidence(F.col("confidence"), F.col("kind"), age_days(F.col("written_at"), now), F.coalesce(expired, F.lit(False))))


def forget(facts: DataFrame, ids: list[int], at: Column) -> DataFrame:
    """Tombstone facts and their twins with the same claim in the same entity."""
    keyed = facts.withColumn("_key", claim_key(F.col("fact")))
    gone = keyed.where(F.col("id").isin(ids)).select("entity_slug", "_key").distinct().withColumn("_gone", F.lit(True))
    return keyed.join(gone, ["entity_slug", "_key"], "left").withColumn("forgotten_at", F.when(F.col("_gone"), F.coalesce("forgotten_at", at)).otherwise(F.col("forgotten_at"))).select(*facts.columns)


def withdrawn(claims: DataFrame, withdrawals: DataFrame) -> DataFrame:
    """Claims whose key was withdrawn for the entity."""
    return claims.withColumn("_key", claim_key(F.col("fact"))).join(withdrawals.select("entity_slug", F.col("claim_key").alias("_key")), ["entity_slug", "_key"], "left_semi").drop("_key")


def as_of(facts: DataFrame, day: Column, keys: list[str], order: list[Column]) -> DataFrame:
    """The row of each key that is valid on ``day``: valid_from <= day < valid_until, first by ``order``."""
    valid = facts.where((F.col("valid_from").isNull() | (F.col("valid_from") <= day)) & (F.col("valid_until").isNull() | (day < F.col("valid_until"))))
    return valid.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def scd2(values: DataFrame, keys: list[str], value: str, at: str) -> DataFrame:
    """Validity intervals of changing values: repeats fold into one row, each row closes where the next value starts."""
    w = Window.partitionBy(*keys).orderBy(at, value)
    changes = values.withColumn("_before", F.lag(value).over(w)).where(F.col("_before").isNull() | (F.col("_before") != F.col(value))).drop("_before")
    return changes.withColumnRenamed(at, "valid_from").withColumn("valid_until", F.lead("valid_from").over(Window.partitionBy(*keys).orderBy("valid_from", value)))


def propose(ontology: DataFrame, proposals: DataFrame) -> DataFrame:
    """Merge proposals (entity, dimension, value, valid_from) into current values (with confidence): the action and the outcome.

    Same value: corroborate (+0.05, at most 1). Older date: backdate. Another, not older value: supersede and close the old one.
    """
    p = proposals.select("entity", "dimension", F.col("value").alias("new_value"), F.col("valid_from").alias("new_from"))
    joined = p.join(ontology, ["entity", "dimension"], "left")
    action = (
        F.when(F.col("value").isNull(), "insert")
        .when((F.col("value") == F.col("new_value")) & (F.col("new_from") < F.col("valid_from")), "backdate")
        .when(F.col("value") == F.col("new_value"), "corroborate")
        .when(F.col("new_from") < F.col("valid_from"), "noop")
        .otherwise("supersede")
    )
    confidence = F.when(action.isin("corroborate", "backdate"), F.least(F.col("confidence") + 0.05, F.lit(1.0))).when(action == "noop", F.col("confidence")).otherwise(0.7)
    return joined.select("entity", "dimension", action.alias("action"), F.when(action == "noop", F.col("value")).otherwise(F.col("new_value")).alias("value"),
                         F.when(action == "backdate", F.col("new_from")).when(action.isin("corroborate", "noop"), F.col("valid_from")).otherwise(F.col("new_from")).alias("valid_from"),
                         confidence.alias("confidence"), F.when(action == "supersede", F.col("new_from")).alias("closes_old_at"))


def conflicts(facts: DataFrame) -> DataFrame:
    """(entity, dimension, n_values, n_sources): two or more values from two or more sources."""
    return facts.groupBy("entity", "dimension").agg(F.countDistinct("value").alias("n_values"), F.countDistinct("source_id").alias("n_sources")).where("n_values >= 2 AND n_sources >= 2")


def contradiction_pairs(facts: DataFrame) -> DataFrame:
    """Pairs of facts (id, entity, dimension, value, source_id) about one dimension in one tenant that differ in value.

    Distinct values are paired, each through its first fact, so many equal facts make no more pairs.
    """
    values = facts.groupBy("entity", "dimension", "source_id", "value").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    a, b = values.alias("a"), values.alias("b")
    same = (F.col("a.entity") == F.col("b.entity")) & (F.col("a.dimension") == F.col("b.dimension")) & F.col("a.source_id").eqNullSafe(F.col("b.source_id"))
    return a.join(b, same & (F.col("b.id") > F.col("a.id")) & (F.col("a.value") != F.col("b.value"))).select(
        F.col("a.entity").alias("entity"), F.col("a.dimension").alias("dimension"), F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"), (F.col("a.n") * F.col("b.n")).alias("n_pairs")
    )


def duplicates(new: DataFrame, stored: DataFrame, same: float = 0.95, likely: float = 0.92) -> DataFrame:
    """Each new fact (id, entity_slug, embedding) with its nearest stored one of the entity: duplicate, likely or new.

    Blocks of new facts meet blocks of stored ones, one matrix product each, of which the nearest of every new fact comes out. Similarities are told apart to
    twelve decimals; equal ones go to the lesser id. A null vector is near nothing, a zero vector has similarity 0.
    """
    def nearest(products: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.arange(len(products)), np.round(products, 12).argmax(axis=1)

    length = norm(F.col("embedding"))
    scaled = F.transform(F.col("embedding"), lambda x: F.when(length > 0, x.cast("double") / length).otherwise(0.0))
    placed = [d.where("embedding IS NOT NULL").select(F.col("entity_slug").alias("bucket"), F.col("id").alias("key"), scaled.alias("unit"), F.array().cast("array<double>").alias("angles")) for d in (new, stored)]
    found = tiles.meetings(*(tiles.blocks(d, []) for d in placed), nearest)
    best = found.groupBy("query_id").agg(F.min(F.struct((-F.round("similarity", 12)).alias("far"), "key")).alias("b"))
    best = new.select("id", "entity_slug").join(best.withColumnRenamed("query_id", "id"), "id", "left").select("id", "entity_slug", F.struct(F.col("b.key").alias("stored_id"), (-F.col("b.far")).alias("similarity")).alias("r"))
    verdict = F.when(F.col("r.similarity") >= same, "duplicate").when(F.col("r.similarity") >= likely, "likely").otherwise("new")
    return best.select("id", "entity_slug", "r.stored_id", "r.similarity", verdict.alias("verdict"))


def leader_clusters(facts: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(source_id, entity_slug, id, leader): in id order a fact joins the first leader of its entity that is near enough, else it leads.

    The order decides, so an entity's facts pass through one task, sorted by Spark and read batch by batch; kept in memory are the
    leaders of one entity alone. Vectors are of one width; a null or zero vector leads itself and no other.
    """
    keys = ["source_id", "entity_slug"]

    def cluster(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        entity, ids, units, n = None, [], np.zeros((0, 0)), 0
        for batch in batches:
            led = []
            for row in batch.itertuples(index=False):
                if (own := (row.source_id, row.entity_slug)) != entity:
                    entity, ids, n = own, [], 0
                v = np.asarray([] if row.embedding is None else row.embedding, dtype=float)
                length = np.linalg.norm(v)
                if not length:
                    led.append(row.id)
                    continue
                if units.shape[1] != len(v):
                    units = np.zeros((16, len(v)))
                v = v / length
                near = np.flatnonzero(units[:n] @ v >= threshold)
                if len(near):
                    led.append(ids[near[0]])
                    continue
                if n == len(units):
                    units = np.concatenate([units, np.zeros_like(units)])
                units[n] = v
                n += 1
                ids.append(row.id)
                led.append(row.id)
            yield batch[[*keys, "id"]].assign(leader=led)

    sorted_ = facts.select(*keys, "id", "embedding").repartition(*keys).sortWithinPartitions(*keys, "id")
    return sorted_.mapInPandas(cluster, "source_id string, entity_slug string, id long, leader long")


def promote(clusters: DataFrame, facts: DataFrame, least: int = 3) -> DataFrame:
    """(source_id, entity_slug, leader, best_id, n, mean_confidence) of clusters with ``least`` members."""
    return clusters.join(facts.select("id", "confidence"), "id").groupBy("source_id", "entity_slug", "leader").agg(
        F.max_by("id", F.struct("confidence", -F.col("id"))).alias("best_id"), F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence")
    ).where(F.col("n") >= least)


def reconcile(fence: DataFrame, store: DataFrame) -> DataFrame:
    """Full outer comparison of the facts a page states and the stored ones: add, keep, forget, or stay withdrawn."""
    f = fence.select("entity_slug", claim_key(F.col("fact")).alias("key"), F.lit(True).alias("stated")).distinct()
    s = store.groupBy("entity_slug", claim_key(F.col("fact")).alias("key")).agg(F.bool_or(F.col("forgotten_at").isNotNull()).alias("tombstone"))
    action = F.when(F.col("tombstone").isNull(), "add").when(F.col("tombstone"), "withdrawn").when(F.col("stated"), "keep").otherwise("forget")
    return f.join(s, ["entity_slug", "key"], "full_outer").select("entity_slug", "key", action.alias("action"))
