"""Products of all vectors of a bucket with all others, block by block.

A block holds at most ``BLOCK_ROWS`` unit vectors of one bucket and one width; a meeting of two blocks is one matrix product inside a task, so
memory is bounded by a block, work is dealt over all pairs of blocks, and no pair of vectors is ever a row unless it is a result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph import reliable_checkpoint

BLOCK_ROWS = 1024
#: Blocks of a side of a bucket that meet others together.
PART_BLOCKS = 32
#: Rows that a task works on at once.
SLICE_ROWS = 1_000_000


def sizes_of(lists: pa.ListArray) -> np.ndarray:
    """The lengths of lists, 0 of a null one."""
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start, as many as its size."""
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def parts(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Runs of the places of ``sizes`` that together have about ``SLICE_ROWS``."""
    if len(sizes):
        part = np.cumsum(sizes) // SLICE_ROWS
        yield from np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(part)) + 1)


def blocks(rows: DataFrame, sort: list[str], rows_a_block: int = BLOCK_ROWS) -> DataFrame:
    """(bucket, width, keys, units, low, high): blocks of ``rows`` (bucket, key, unit: array<double>, angles: array<double>), cut where one of ``sort``
    changes, keys ascending; ``low`` and ``high`` bound the block's angles. Rows are sorted by Spark and read batch by batch."""
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("bucket", "key")}
    columns = ["bucket", "key", "unit", "angles"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            n = whole.num_rows
            if not n:
                continue
            marks = [whole.column(c).to_pylist() for c in ("_group", "bucket", "_width")]
            cuts = [0, *(i for i in range(1, n) if any(m[i] != m[i - 1] for m in marks)), n]
            for begin, end in zip(cuts, cuts[1:], strict=False):
                for at in range(begin, end, rows_a_block):
                    part = whole.slice(at, min(rows_a_block, end - at))
                    wide = lambda c, part=part: np.asarray(part.column(c).flatten(), dtype=np.float64).reshape(part.num_rows, -1)
                    units, angles = wide("unit"), wide("angles")
                    keys = pa.array([part.column("key").to_pylist()], pa.list_(part.schema.field("key").type))
                    low, high = (pa.array([f(angles, axis=0).tolist()], pa.list_(pa.float64())) for f in (np.min, np.max))
                    out = [part.column("bucket").slice(0, 1), pa.array([units.shape[1]], pa.int32()), keys, pa.array([units.tobytes()], pa.binary()), low, high]
                    yield pa.RecordBatch.from_arrays(out, names=["bucket", "width", "keys", "units", "low", "high"])

    marked = rows.select(*columns, F.size("unit").alias("_width"), F.xxhash64("bucket", F.size("unit"), *sort).alias("_group")).where("_width > 0")
    ordered = marked.repartitionByRange("_group", F.xxhash64("unit")).sortWithinPartitions("_group", "bucket", "_width", "key")
    return ordered.mapInArrow(pack, f"bucket {kinds['bucket']}, width int, keys array<{kinds['key']}>, units binary, low array<double>, high array<double>")


def meetings(asked: DataFrame, stored: DataFrame, found: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], near: Column | None = None, part_blocks: int = PART_BLOCKS) -> DataFrame:
    """(query_id, key, similarity): for each pair of blocks of one bucket and width the places that ``found`` picks from their products. Each side of a
    bucket is dealt in parts of about ``part_blocks`` blocks; what comes together under one key is two parts, however large the bucket is."""
    of = lambda d, c: d.schema[c].dataType.elementType.simpleString()
    kinds = of(asked, "keys"), of(stored, "keys")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                width = batch.column("width")[i].as_py()
                one, two = (np.frombuffer(batch.column(c)[i].as_buffer(), dtype=np.float64).reshape(-1, width) for c in ("asked_units", "units"))
                products = one @ two.T
                r, c = found(products)
                out = [batch.column("asked_keys")[i].values.take(pa.array(r)), batch.column("keys")[i].values.take(pa.array(c)), pa.array(products[r, c])]
                yield pa.RecordBatch.from_arrays(out, names=["query_id", "key", "similarity"])

    counts = [d.groupBy("bucket", "width").agg(F.ceil(F.count("*") / part_blocks).alias(f"{side}_parts")) for d, side in ((asked, "asked"), (stored, "stored"))]
    parts = reliable_checkpoint(counts[0].join(counts[1], ["bucket", "width"]))  # both sides have to be dealt by the same numbers

    def dealt(d: DataFrame, own: str, other: str) -> DataFrame:
        """Each block in one part of its own side, once for each part of the other."""
        placed = d.join(parts, ["bucket", "width"]).withColumn(f"{own}_part", F.pmod(F.xxhash64("units"), F.col(f"{own}_parts")))
        return placed.withColumn(f"{other}_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{other}_parts") - 1))).drop("asked_parts", "stored_parts")

    left = dealt(asked, "asked", "stored").select("bucket", "width", "asked_part", "stored_part", *(F.col(c).alias(f"asked_{c}") for c in ("keys", "units", "low", "high")))
    pairs = left.join(dealt(stored, "stored", "asked"), ["bucket", "width", "asked_part", "stored_part"])
    pairs = pairs if near is None else pairs.where(near)
    return pairs.select("width", "asked_keys", "asked_units", "keys", "units").mapInArrow(meet, f"query_id {kinds[0]}, key {kinds[1]}, similarity double")
