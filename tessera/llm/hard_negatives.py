"""Hard-negative mining by exact inner-product search under an orthogonal PCA rotation (Lian et al., 2015; Teflioudi and Gemulla, 2016).

Vectors become integers, ``floor(scale * x)``. Their second moments, summed over all rows, give an orthogonal rotation whose leading
components carry most of every inner product. A block of anchors goes to the workers; each block of rows multiplies its leading
components with theirs, and what the other components can add or take away is at most the product of the residual norms (and a
slack for rounding). Pairs that cannot reach what an anchor still needs are discarded, the others get more components, and survivors
are verified by integer products; results do not depend on the rotation.

Anchors are a stated set. They are taken ``ANCHORS`` at a time, one pass over the rows for their positives and one for their negatives a
block, so what is broadcast is bounded and no vector but the anchors is shuffled; each task returns the best few rows for each anchor.

Defined results: rows with a null id, a null label, a null vector, or a null or non-finite component (also after scaling) take no part; shorter vectors
count as if zeros followed, an empty one as zeros; vectors of any length are multiplied whole; repeated rows take part each, but an anchor that is
given twice (id, label and components) counts once and a row with the anchor's id is not its positive; higher scores come first, ties by
smaller id, and rows alike in both in any order; scores beyond 64 bits are held at their ends; anchors without positives or negatives give no row; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import compact, with_checkpoint_dir

#: Anchors that workers hold at a time.
ANCHORS = 4096
#: Components that the rotation mixes; any others follow as they are.
ROTATED = 256
#: Rows and anchors that are multiplied at a time, and pairs that are looked at one by one.
TILE_ROWS, TILE_ANCHORS, PAIRS = 2048, 512, 50_000
#: Bound of the error of a float64 product in the rotated space, over the product of the norms, for up to 10,000 components.
SLACK = 1e-9
LONG = np.iinfo(np.int64)


def integer_rows(batch: pa.RecordBatch, scale: int, dims: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, labels and whole-numbered components (as float64, padded with zeros) of the rows of (id, label, vector) that take part."""
    vectors = batch.column(2)
    sizes = np.diff(vectors.offsets.to_numpy())
    sizes[~vectors.is_valid().to_numpy(zero_copy_only=False)] = 0
    values = np.floor(scale * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    row, bad = np.repeat(np.arange(len(sizes)), sizes), np.zeros(len(sizes), dtype=bool)
    bad[row[~np.isfinite(values)]] = True
    for column in batch.columns:
        bad |= ~column.is_valid().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), max(dims or 0, int(sizes.max(initial=0)))))
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    ids, labels = (batch.column(i).fill_null(0).to_numpy() for i in (0, 1))
    return ids[~bad], labels[~bad], out[~bad]


def products(rows: np.ndarray, anchors: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Integer inner products of rows ``i`` with anchors ``j``, held at the ends of 64 bits."""
    largest = float(np.abs(rows).max(initial=0)) * float(np.abs(anchors).max(initial=0)) * rows.shape[1]
    out = np.empty(len(i), dtype=np.int64)
    for at in range(0, len(i), PAIRS):
        a, b = rows[i[at : at + PAIRS]], anchors[j[at : at + PAIRS]]
        if largest < 2**53:
            out[at : at + PAIRS] = np.einsum("ij,ij->i", a, b)
        else:
            exact = [sum(int(x) * int(y) for x, y in zip(r, s, strict=True)) for r, s in zip(a.tolist(), b.tolist(), strict=True)]
            out[at : at + PAIRS] = [min(max(x, LONG.min), LONG.max) for x in exact]
    return out


class Rotation:
    """An orthogonal matrix and the numbers of leading components after which pairs are tested."""

    def __init__(self, moments: np.ndarray, dims: int) -> None:
        self.matrix = np.eye(dims)
        if len(moments) and np.isfinite(moments).all():
            k = len(moments)
            self.matrix[:k, :k] = np.linalg.eigh(moments)[1][:, ::-1]
        self.steps = [m for m in (8, 16, 32, 64, 128, 256, 512, 1024) if m < dims] + [dims]

    def turned(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rotated rows, and for each step the norm of the components that are left (and the whole norm, last)."""
        with np.errstate(over="ignore", invalid="ignore"):
            out = rows @ self.matrix
            squares = np.cumsum(out[:, ::-1] ** 2, axis=1)[:, ::-1]
        tails = np.concatenate([squares, np.zeros((len(out), 1))], axis=1)[:, [*self.steps, 0]] if out.shape[1] else np.zeros((len(out), len(self.steps) + 1))
        return out, np.sqrt(tails)


class Anchors:
    """A block of anchors in a worker, rotated once."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, rotation: Rotation) -> None:
        self.ids, self.labels, self.vectors, self.rotation = ids, labels, vectors, rotation
        self.turned, self.tails = rotation.turned(vectors)

    def survivors(self, rows: np.ndarray, turned: np.ndarray, tails: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, anchor, score) of all pairs with anchors ``at`` whose score is within the anchor's ``low`` and ``high``, ends included."""
        steps, part, first, k = self.rotation.steps, 0.0, 0, 0

        def kept(sums: np.ndarray, rest: np.ndarray, norms: np.ndarray, anchors: np.ndarray) -> np.ndarray:
            margin = rest + SLACK * norms
            return ~((sums + margin < low[anchors]) | (sums - margin > high[anchors]))  # what is not a number is kept

        with np.errstate(over="ignore", invalid="ignore"):
            norms = np.outer(tails[:, -1], self.tails[at, -1])
            while True:  # whole tiles, as long as many pairs are left
                part = part + turned[:, first : steps[k]] @ self.turned[at, first : steps[k]].T
                i, j = np.nonzero(kept(part, np.outer(tails[:, k], self.tails[at, k]), norms, at))
                first, k = steps[k], k + 1
                if k == len(steps) or 8 * len(i) <= part.size:
                    break
            done = []
            for start in range(0, len(i), PAIRS):
                a, b, sums = i[start : start + PAIRS], at[j[start : start + PAIRS]], part[i[start : start + PAIRS], j[start : start + PAIRS]]
                for before, after in zip(range(k - 1, len(steps)), range(k, len(steps)), strict=False):
                    span = slice(steps[before], steps[after])
                    sums = sums + np.einsum("ij,ij->i", turned[a, span], self.turned[b, span])
                    stay = kept(sums, tails[a, after] * self.tails[b, after], tails[a, -1] * self.tails[b, -1], b)
                    a, b, sums = a[stay], b[stay], sums[stay]
                done.append((a, b))
        i, j = (np.concatenate([d[s] for d in done] or [np.zeros(0, dtype=np.int64)]) for s in (0, 1))
        scores = products(rows, self.vectors, i, j)
        good = (scores >= low[j]) & (scores <= high[j])
        return i[good], j[good], scores[good]


class Best:
    """The first ``k`` of the candidates of each slot, by score and then smaller id."""

    def __init__(self, slots: int, k: int) -> None:
        self.k = k
        self.slot, self.score, self.id = (np.zeros(0, dtype=np.int64) for _ in range(3))
        self.least = np.full(slots, LONG.min)  # the last of ``k`` scores, where there are as many

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        slot, score, ids = np.concatenate([self.slot, slot]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, ~score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        place = np.arange(len(slot)) - np.searchsorted(slot, slot)
        self.slot, self.score, self.id = slot[place < self.k], score[place < self.k], ids[place < self.k]
        last = place == self.k - 1
        self.least[slot[last]] = score[last]


def tiles(labels: np.ndarray, anchor_labels: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of one label and anchors of the same label, or of others, a tile at a time."""
    for label in np.unique(labels):
        rows = np.flatnonzero(labels == label)
        anchors = np.flatnonzero((anchor_labels == label) == same)
        for r in range(0, len(rows), TILE_ROWS):
            for a in range(0, len(anchors), TILE_ANCHORS):
                yield rows[r : r + TILE_ROWS], anchors[a : a + TILE_ANCHORS]


def _whole_rows(batches: Iterator[pa.RecordBatch], scale: int, dims: int, rotation: Rotation) -> Iterator[tuple[np.ndarray, ...]]:
    for batch in batches:
        for at in range(0, batch.num_rows, TILE_ROWS):
            ids, labels, rows = integer_rows(batch.slice(at, TILE_ROWS), scale, dims)
            yield ids, labels, rows, *rotation.turned(rows)


def moments(rows: DataFrame, scale: int, rotated: int = ROTATED) -> tuple[np.ndarray, int]:
    """Second moments of the first ``rotated`` components of all rows, and the greatest number of components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, dims = np.zeros((0, 0)), 0
        for batch in batches:
            _, _, part = integer_rows(batch, scale, dims)
            dims = max(dims, part.shape[1])
            k = min(dims, rotated)
            total = np.pad(total, (0, k - len(total)))
            with np.errstate(over="ignore", invalid="ignore"):
                total = total + part[:, :k].T @ part[:, :k]
        i, j = np.triu_indices(len(total))
        cells = (i.tolist() + [-1], j.tolist() + [dims], total[i, j].tolist() + [0.0])
        yield pa.RecordBatch.from_arrays([pa.array(cells[0], pa.int32()), pa.array(cells[1], pa.int32()), pa.array(cells[2], pa.float64())], names=["i", "j", "v"])

    summed = rows.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow().to_pydict()
    i, j, v = (np.array(summed[c], dtype=d) for c, d in (("i", np.int64), ("j", np.int64), ("v", np.float64)))
    dims = int(j[i < 0].max(initial=0))
    out = np.zeros((min(dims, rotated),) * 2)
    cell = i >= 0
    out[i[cell], j[cell]] = v[cell]
    out[j[cell], i[cell]] = v[cell]
    return out, dims


def best_rows(found: DataFrame, slots: list[str], k: int) -> DataFrame:
    """The first ``k`` of ``found`` for each of the slots, over what the tasks returned."""
    order = Window.partitionBy(*slots).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256,
    id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", anchors_at_once: int = ANCHORS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank).

    For each row that ``is_anchor``, its first ``positives`` other rows of the same label; for each of these, the first ``negatives`` rows of other labels whose
    score is ``low`` to ``high`` hundredths of the positive's (both at least 0).
    """
    spark = vectors.sparkSession
    with_checkpoint_dir(spark)
    flagged = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"), is_anchor.alias("anchor"))
    rows = flagged.drop("anchor")
    second, dims = moments(rows, scale)
    rotation = Rotation(second, dims)
    queries = compact(flagged.where("anchor").drop("anchor").dropDuplicates(), anchors_at_once).withColumn("at", F.monotonically_increasing_id())
    queries = queries.withColumn("block", F.col("at") - F.pmod("at", F.lit(anchors_at_once)))  # no block holds more than ``anchors_at_once``
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long, positive_rank int"
    folder = f"{spark.sparkContext.getCheckpointDir()}/hard-negatives-{uuid.uuid4().hex}"
    spark.createDataFrame([], schema).write.parquet(folder)
    for block in sorted(r["block"] for r in queries.select("block").distinct().collect()):
        members = queries.where(F.col("block") == block).select("id", "label", "vector").toArrow().combine_chunks().to_batches()
        ids, labels, whole = integer_rows(members[0], scale, dims)
        order = np.lexsort((ids, labels))
        if len(order):
            _mine_block(rows, Anchors(ids[order], labels[order], whole[order], rotation), scale, dims, positives, negatives, low, high).write.mode("append").parquet(folder)
    return spark.read.schema(schema).parquet(folder)


def _mine_block(rows: DataFrame, anchors: Anchors, scale: int, dims: int, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    spark = rows.sparkSession
    held = spark.sparkContext.broadcast(anchors)
    n = len(anchors.ids)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = held.value
        best, top = Best(n, positives), np.full(n, LONG.max)
        for ids, labels, whole, turned, tails in _whole_rows(batches, scale, dims, block.rotation):
            for r, a in tiles(labels, block.labels, same=True):
                i, j, scores = block.survivors(whole[r], turned[r], tails[r], a, best.least, top)
                other = ids[r][i] != block.ids[j]
                best.add(j[other], scores[other], ids[r][i[other]])
        yield pa.RecordBatch.from_arrays([pa.array(best.slot), pa.array(best.id), pa.array(best.score)], names=["anchor", "id", "score"])

    found = best_rows(rows.mapInArrow(nearest, "anchor long, id long, score long"), ["anchor"], positives).toArrow()  # at most ``positives`` an anchor
    anchor, place, positive_id, positive = (found[c].to_numpy().astype(np.int64) for c in ("anchor", "rank", "id", "score"))
    slots = spark.sparkContext.broadcast(bands(n, positives, anchor, place, positive, low, high))

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, (least, most) = held.value, slots.value
        best = Best(n * positives, negatives)
        best.least = least.reshape(-1).copy()
        for ids, labels, whole, turned, tails in _whole_rows(batches, scale, dims, block.rotation):
            for r, a in tiles(labels, block.labels, same=False):
                needed = best.least.reshape(n, positives).min(axis=1, initial=LONG.max, where=least <= most)
                i, j, scores = block.survivors(whole[r], turned[r], tails[r], a, needed, most.max(axis=1, initial=LONG.min, where=least <= most))
                pair, p = np.nonzero((scores[:, None] >= best.least.reshape(n, positives)[j]) & (scores[:, None] <= most[j]))
                best.add(j[pair] * positives + p, scores[pair], ids[r][i[pair]])
        yield pa.RecordBatch.from_arrays([pa.array(best.slot), pa.array(best.id), pa.array(best.score)], names=["slot", "id", "score"])

    kept = best_rows(rows.mapInArrow(within, "slot long, id long, score long"), ["slot"], negatives)
    given = pa.table({"slot": anchor * positives + place - 1, "anchor_id": anchors.ids[anchor], "positive_id": positive_id, "positive_score": positive, "positive_rank": place.astype(np.int32)})
    return kept.join(F.broadcast(spark.createDataFrame(given)), "slot").select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"), "positive_rank"
    )


def bands(n: int, positives: int, anchor: np.ndarray, place: np.ndarray, score: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score of a negative for each anchor and place of a positive; no score fits where there is no positive, or a negative one."""
    least, most = np.full((n, positives), LONG.max), np.full((n, positives), LONG.min)
    for a, p, s in zip(anchor.tolist(), place.tolist(), score.tolist(), strict=True):
        if s >= 0:
            least[a, p - 1], most[a, p - 1] = -(-low * s // 100), high * s // 100
    return least, most


#: DuckDB SQL for the rows of the registered query.
ORACLE = """
WITH rows AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM rows a JOIN rows b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (SELECT anchor_id, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS positive_rank FROM pairs WHERE same
  QUALIFY positive_rank <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS rank, id AS negative_id, positive_score, score AS negative_score, positive_rank
FROM positives JOIN pairs USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 10
"""
