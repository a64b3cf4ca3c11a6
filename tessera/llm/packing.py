"""Sequence packing by shortest-pack-first over the length histogram (Krell et al., 2021).

Documents are tokenized and cut into pieces of at most ``capacity`` tokens. The plan is made from the
histogram of piece lengths alone, at most ``capacity`` numbers whatever the corpus size: lengths are
placed longest first, each into the packing pattern with the least tokens, whose count is updated; a pattern
is a multiset of lengths with a number of sequences. A piece then finds its sequence by its rank among the pieces
of its length. Ranks are made in groups of about ``GROUP_ROWS`` pieces, as many as a length needs, with offsets from the groups' sizes, so
that one length that holds a large share of the pieces is not ranked in one task; the slot of a rank is found by binary search
in the plan, whose size is bounded by the capacity.

Defined results: null text is an empty document and still has its closing token; repeated rows (also of
a repeated doc_id) are packed each; a null doc_id is kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import checkpointed, fresh_names
from tessera.llm.tokens import CLOSING_ID, WordEncoder, default_tokenizer_path, token_pieces

__all__ = ["CLOSING_ID", "WordEncoder", "default_tokenizer_path", "token_pieces"]

CAPACITY = 2048
#: Pieces that one task ranks.
GROUP_ROWS = 200_000
Patterns = list[tuple[tuple[int, ...], int]]


def shortest_pack_first(histogram: dict[int, int], capacity: int = CAPACITY) -> Patterns:
    """Packing patterns (lengths in order of placing, number of sequences) for a histogram of lengths.

    Lengths are placed longest first. Of the patterns with room, the one with the least tokens takes the
    length: as many of its sequences as there are pieces left get it and become a new pattern.
    """
    by_size: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    sizes: list[int] = []  # ascending

    def add(pattern: tuple[int, ...], count: int) -> None:
        size = sum(pattern)
        if size not in by_size:
            by_size[size] = []
            bisect.insort(sizes, size)
        by_size[size].append((pattern, count))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left > 0:
            if not sizes or sizes[0] + length > capacity:
                fit = max(1, capacity // length)
                # new sequences: with as many of this length as fit
                if left >= fit:
                    add((length,) * fit, left // fit)
                    left %= fit
                else:
                    add((length,) * left, 1)
                    left = 0
                continue
            size = sizes[0]
            pattern, count = by_size[size].pop()
            if not by_size[size]:
                del by_size[size]
                sizes.pop(0)
            fit = min((capacity - size) // length, -(-left // count))
            used = min(count, left // fit)
            add(pattern + (length,) * fit, used)
            left -= used * fit
            if used < count:
                add(pattern, count - used)
    return [p for size in sizes for p in by_size[size]]


def pattern_slots(patterns: Patterns) -> list[tuple[int, int, int, int, int]]:
    """(length, first_rank, last_rank, first_sequence, offset): which ranks of a length fill which slot of which sequences."""
    placed: Counter[int] = Counter()
    slots, sequence = [], 0
    for pattern, count in patterns:
        offset = 0
        for length in pattern:
            slots.append((length, placed[length], placed[length] + count - 1, sequence, offset))
            placed[length] += count
            offset += length
        sequence += count
    return slots


def assign_sequences(
    pieces: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS, plan_for: Callable[[dict[int, int], int], Patterns] = shortest_pack_first
) -> DataFrame:
    """``pieces`` (doc_id, start, length and any others) with sequence_id and offset, by the patterns that ``plan_for`` makes of the
    histogram of lengths. ``pieces`` is read twice and has to give the same partitions each time, as a checkpointed or written table does."""
    spark = pieces.sparkSession
    group, first, rank = fresh_names(pieces, "group", "first", "rank")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    groups = spark.createDataFrame([(n, c // group_rows + 1) for n, c in sorted(histogram.items())], f"length long, {group} long")
    dealt = pieces.join(F.broadcast(groups), "length").withColumn(group, F.pmod(F.monotonically_increasing_id(), F.col(group)))
    sizes = dealt.groupBy("length", group).agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("length", group, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(first))
    within = Window.partitionBy("length", group).orderBy("doc_id", "start")
    ranked = dealt.withColumn(rank, F.row_number().over(within) - 1).join(firsts, ["length", group]).withColumn(rank, F.col(rank) + F.col(first))

    slots = np.array(pattern_slots(plan_for(histogram, capacity)), dtype=np.int64).reshape(-1, 5)
    slots = slots[np.lexsort((slots[:, 1], slots[:, 0]))]
    plan = spark.sparkContext.broadcast((slots[:, 0] << 44 | slots[:, 1], slots[:, 3] - slots[:, 1], slots[:, 4]))
    names = [c for c in pieces.columns if c != "length"]
    schema = T.StructType([*(pieces.schema[c] for c in names), *(T.StructField(c, T.LongType()) for c in ("length", "sequence_id", "offset"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins, sequence, offset = plan.value
        for batch in batches:
            ranks = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            slot = np.searchsorted(begins, batch.column(batch.num_columns - 2).to_numpy(zero_copy_only=False) << 44 | ranks, "right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence[slot] + ranks), pa.array(offset[slot])], names=schema.names)

    return ranked.select(*names, "length", F.col(rank).cast("long")).mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids_crc32, sequence_id, offset), one row for each piece.

    The pieces' figures are checkpointed, so the texts are tokenized once. The ids themselves stay with
    ``token_pieces``; ``packed_ids`` joins them to their places.
    """
    figures = checkpointed(token_pieces(docs, tokenizer_path, capacity, with_ids=False))
    return assign_sequences(figures, capacity)


def packed_ids(
    docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, plan_for: Callable[[dict[int, int], int], Patterns] = shortest_pack_first
) -> DataFrame:
    """(sequence_id, length, ids): the packed sequences themselves, each at most ``capacity`` ids as bytes."""
    pieces = checkpointed(token_pieces(docs, tokenizer_path, capacity))
    placed = assign_sequences(pieces, capacity, plan_for=plan_for)
    rows = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.sum("length").alias("length"), rows.alias("p")).select(
        "sequence_id", "length", F.aggregate("p", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"])).alias("ids")
    )
