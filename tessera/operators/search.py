"""Retrieval: lexical, vector and title arms, fusion, score stages and result shaping, for many queries in one plan.

Hits carry query_id and id; every window is partitioned by query_id, so a batch of queries is one job. Candidates are cut with top-k
per query before texts are joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import rank as R
from tessera.functions.text import title_tokens, tokens
from tessera.functions.vector import cosine


def top_k(hits: DataFrame, k: int, score: str = "score", by: str = "query_id", tie: str = "id") -> DataFrame:
    """The k best rows of each query with their rank, ties by id. The rank limit is pushed below the shuffle by Spark's window group limit."""
    order = Window.partitionBy(by).orderBy(F.desc(score), F.asc(tie))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term): the distinct terms of queries (query_id, query)."""
    return queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query")))).alias("term"))


BLOCK_ROWS = 1024
#: Blocks of queries whose best rows a task keeps at once.
HELD_BLOCKS = 64


def _blocks(vectors: DataFrame, key: str, vector: str, rows: int) -> DataFrame:
    """(keys, width, units): blocks of at most ``rows`` vectors as unit vectors in one binary value, keys ascending."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                part = pa.Table.from_batches([whole.slice(at, rows)])
                part = part.filter(pc.is_valid(part.column(1))).combine_chunks()
                if not part.num_rows:
                    continue
                part = part.take(pc.sort_indices(part.column(0))).combine_chunks()
                values = np.asarray(part.column(1).combine_chunks().flatten(), dtype=np.float64).reshape(part.num_rows, -1)
                lengths = np.sqrt((values * values).sum(axis=1, keepdims=True))
                units = np.divide(values, lengths, out=np.zeros_like(values), where=lengths > 0)
                keys = pa.array([part.column(0).to_pylist()], pa.list_(part.schema.field(0).type))
                yield pa.RecordBatch.from_arrays([keys, pa.array([units.shape[1]], pa.int32()), pa.array([units.tobytes()], pa.binary())], names=["keys", "width", "units"])

    kind = vectors.schema[key].dataType.simpleString()
    return vectors.select(key, F.col(vector).cast("array<double>")).mapInArrow(pack, f"keys array<{kind}>, width int, units binary")


def vector_arm(vectors: DataFrame, queries: DataFrame, k: int, rows: int = BLOCK_ROWS) -> DataFrame:
    """Exact nearest neighbours by cosine of a stated set of queries (query_id, query_vector) among vectors (id, vector) of the same width.

    Blocks of queries meet blocks of vectors, each meeting being one matrix product that gives the k best of every query in it. A task keeps the k best
    of all its meetings, so what is sorted and shuffled is k rows for each query and task. Scores are told apart to twelve decimals; ties go to the lesser id. A null
    vector is in no result, a zero vector has cosine 0.
    """
    kinds = queries.schema["query_id"].dataType.simpleString(), vectors.schema["id"].dataType.simpleString()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple, tuple[pa.Array, pa.Array, np.ndarray]] = {}  # of each block of queries: their keys, and ids and scores of the best rows so far, row by row

        def rows() -> Iterator[pa.RecordBatch]:
            for asked, ids, scores in best.values():
                out = [asked.take(pa.array(np.repeat(np.arange(len(scores)), scores.shape[1]))), ids, pa.array(scores.ravel())]
                yield pa.RecordBatch.from_arrays(out, names=["query_id", "id", "score"])

        for batch in batches:
            for i in range(batch.num_rows):
                asked, ids = batch.column("query_keys")[i].values, batch.column("keys")[i].values
                block = lambda name, width=batch.column("width")[i].as_py(), i=i: np.frombuffer(batch.column(name)[i].as_buffer(), dtype=np.float64).reshape(-1, width)
                scores = np.round(block("query_units") @ block("units").T, 12)
                at = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                ids, scores = ids.take(pa.array(at.ravel())), np.take_along_axis(scores, at, 1)
                name = batch.column("query_block")[i].as_py()
                if name in best:
                    asked, old, high = best[name]
                    # ties go to the lesser id, so both are ordered by score and id
                    both, scores = pa.concat_arrays([old, ids]), np.concatenate([high, scores], axis=1)
                    spot = np.concatenate([np.arange(high.size).reshape(high.shape), high.size + np.arange(len(ids)).reshape(len(high), -1)], axis=1)
                    place = np.empty(len(both), dtype=np.int64)
                    place[pc.sort_indices(both).to_numpy()] = np.arange(len(both))
                    at = np.lexsort((place[spot], -scores), axis=1)[:, :k]
                    ids, scores = both.take(pa.array(np.take_along_axis(spot, at, 1).ravel())), np.take_along_axis(scores, at, 1)
                elif len(best) == HELD_BLOCKS:
                    yield from rows()
                    best.clear()
                best[name] = asked, ids, scores
        yield from rows()

    asked = _blocks(queries, "query_id", "query_vector", rows).select(F.col("keys").alias("query_keys"), F.col("units").alias("query_units"), F.sha2("units", 256).alias("_units"))
    asked = asked.select("query_keys", "query_units", F.concat_ws(" ", "_units", F.sha2(F.to_json("query_keys"), 256)).alias("query_block"))
    pairs = _blocks(vectors, "id", "vector", rows).crossJoin(asked)  # blocks with blocks
    return top_k(pairs.mapInArrow(meet, f"query_id {kinds[0]}, id {kinds[1]}, score double"), k)


def query_ngrams(query: Column, longest: int = 8) -> Column:
    """All contiguous runs of up to ``longest`` tokens."""
    words = title_tokens(query)
    return F.array_distinct(
        F.flatten(
            F.transform(
                F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1))),
                lambda i: F.transform(F.sequence(F.lit(1), F.greatest(F.least(F.lit(longest), F.size(words) - i + 1), F.lit(1))), lambda n: F.array_join(F.slice(words, i, n), " ")),
            )
        )
    )


def title_arm(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Documents whose normalised title is a run of query tokens; longer titles first."""
    grams = queries.select("query_id", F.explode(query_ngrams(F.col("query"))).alias("title_norm"))
    titles = docs.select("id", F.array_join(title_tokens(F.col("title")), " ").alias("title_norm")).where("title_norm <> ''")
    # all documents of a title score alike, so the k least ids of each are enough for every query
    order = Window.partitionBy("title_norm").orderBy("id")
    titles = titles.distinct().withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n")
    hits = titles.join(grams, "title_norm").groupBy("query_id", "id").agg(F.max(F.size(F.split("title_norm", " "))).cast("double").alias("score"))
    return top_k(hits, k)


def fuse(arms: DataFrame) -> DataFrame:
    """(query_id, id, score, n_arms): reciprocal rank fusion of (query_id, arm, id, rank, weight)."""
    return arms.groupBy("query_id", "id").agg(F.sum(R.rrf(F.col("rank"), F.col("weight"))).alias("score"), F.count("*").alias("n_arms"))


def cosine_blend(hits: DataFrame, cosine_col: str = "cosine") -> DataFrame:
    """0.7 of the score over the query's best and 0.3 of the cosine; hits without a vector keep their score."""
    best = F.max("score").over(Window.partitionBy("query_id"))
    blended = 0.7 * F.col("score") / best + 0.3 * F.col(cosine_col)
    return hits.withColumn("score", F.when(F.col(cosine_col).isNull() | (best == 0), F.col("score")).otherwise(blended))


def floor_gate(hits: DataFrame, ratio: float) -> DataFrame:
    """Hits at or above a share of their query's best score."""
    best = F.max("score").over(Window.partitionBy("query_id"))
    return hits.withColumn("_best", best).where(F.col("score") >= F.col("_best") * ratio).drop("_best")


def boosted(hits: DataFrame, now: Column) -> DataFrame:
    """Hits (path, updated_at, kind, weight, pinned, salience, backlinks) with one column for each factor and their product."""
    # computed once, before the CASE chains that look at them many times
    hits = hits.withColumns({"_path": R.normalized_path(F.col("path")), "_age": R.age_days(F.col("updated_at"), now)})
    path, age = F.col("_path"), F.col("_age")
    factors = {
        "f_curation": R.curation(path),
        "f_source": R.source_boost(F.col("kind")),
        "f_recency": R.recency_decay(path, age),
        "f_salience": R.frontmatter_salience(F.col("weight"), F.col("pinned")),
        "f_mattering": R.mattering(F.coalesce("salience", F.lit(0.0))),
        "f_backlinks": R.backlink_boost(F.coalesce("backlinks", F.lit(0))),
    }
    out = hits.where(~R.excluded(path)).withColumns(factors)
    product = F.col("score")
    for f in factors:
        product = product * F.col(f)
    return out.withColumn("score", product).drop("_path", "_age")


def best_per_document(hits: DataFrame) -> DataFrame:
    """The best chunk of each document of a query, ties by id."""
    order = Window.partitionBy("query_id", "document_id").orderBy(F.desc("score"), F.asc("id"))
    return hits.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def cap_per_document(hits: DataFrame, cap: int) -> DataFrame:
    """The first ``cap`` rows of each document in rank order."""
    order = Window.partitionBy("query_id", "document_id").orderBy("rank")
    return hits.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= cap).drop("_n")


def diversify_types(hits: DataFrame, share: float = 0.6) -> DataFrame:
    """At most ceil(share * n) rows, and at least one, of each type where a query has several types."""
    whole, own = Window.partitionBy("query_id"), Window.partitionBy("query_id", "type").orderBy("rank")
    sized = hits.withColumns({"_n": F.count("*").over(whole), "_kinds": F.size(F.collect_set(F.coalesce("type", F.lit(""))).over(whole)), "_at": F.row_number().over(own)})
    return sized.where((F.col("_kinds") <= 1) | (F.col("_at") <= F.greatest(F.ceil(F.col("_n") * share), F.lit(1)))).drop("_n", "_kinds", "_at")


def estimated_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 4)


def within_token_budget(hits: DataFrame, budget: int, cost: Column | None = None) -> DataFrame:
    """The longest prefix in rank order whose estimated tokens, ``cost`` or else those of its texts, fit."""
    cost = estimated_tokens(F.col("text")) if cost is None else cost
    spent = F.sum(cost).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return hits.withColumn("spent", spent).where(F.col("spent") <= budget)


def demote_same_session(hits: DataFrame, factor: float = 0.95) -> DataFrame:
    """All but the best row of a session lose a little."""
    order = Window.partitionBy("query_id", "session").orderBy(F.desc("score"), "id")
    n = F.row_number().over(order)
    return hits.withColumn("_n", n).withColumn("score", F.when(F.col("session").isNotNull() & (F.col("_n") > 1), F.col("score") * factor).otherwise(F.col("score"))).drop("_n")


def near_duplicate_texts(hits: DataFrame, threshold: float = 0.85, min_tokens: int = 12) -> DataFrame:
    """Rows kept by a greedy pass in rank order over each query's few hits: a row too like an earlier kept one goes."""
    import pandas as pd

    def keep(group: pd.DataFrame) -> pd.DataFrame:
        kept: list[set[str]] = []
        rows = []
        for i, text in group.sort_values("rank")["text"].items():
            words = set((text or "").lower().split())
            # sets of sizes too far apart can't be so alike, and are not compared
            near = (k for k in kept if min(len(words), len(k)) >= threshold * max(len(words), len(k)))
            if len(words) >= min_tokens and any((n := len(words & k)) / (len(words) + len(k) - n) > threshold for k in near):
                continue
            if len(words) >= min_tokens:
                kept.append(words)
            rows.append(i)
        return group.loc[rows]

    return hits.groupBy("query_id").applyInPandas(keep, hits.schema)


def evidence(hits: DataFrame) -> DataFrame:
    """Why a hit is trusted: title, both arms in the first three ranks, keyword alone, or weak; and whether its subject exists."""
    kind = (
        F.when(F.col("title_hit"), "title")
        .when(F.col("vector_hit") & F.col("keyword_hit") & (F.col("rank") <= 3), "high_vector")
        .when(F.col("keyword_hit"), "keyword")
        .otherwise("weak")
    )
    safe = F.when(kind == "title", "exists").when(kind.isin("high_vector", "keyword"), "probable").otherwise("unknown")
    return hits.withColumns({"evidence": kind, "create_safety": safe})


def adaptive_return(hits: DataFrame) -> DataFrame:
    """Two rows for factual and exact queries, six for others."""
    return hits.where(F.col("rank") <= F.when(F.col("intent").isin("factual", "exact"), 2).otherwise(6))


def refine(primary: DataFrame, second: DataFrame) -> DataFrame:
    """Fusion of two rankings (query_id, id, rank), restricted to the first one's ids."""
    arms = primary.select("query_id", "id", "rank").unionByName(second.join(primary.select("query_id", "id"), ["query_id", "id"], "left_semi").select("query_id", "id", "rank"))
    return arms.groupBy("query_id", "id").agg(F.sum(R.rrf(F.col("rank"))).alias("score"))


def cache_is_fresh(entries: DataFrame, generations: DataFrame) -> DataFrame:
    """(key, fresh): all documents of an entry (key, doc_generations map) are still at the generation it saw."""
    seen = entries.select("key", F.explode_outer("doc_generations").alias("document_id", "seen"))
    return seen.join(generations, "document_id", "left").groupBy("key").agg(F.bool_and(F.col("document_id").isNull() | (F.coalesce("generation", F.lit(-1)) == F.col("seen"))).alias("fresh"))
