"""Packing whole documents into few sequences by the sum-of-squares rule (Csirik et al., 2006), over the length histogram.

Documents longer than ``capacity`` tokens are cut into pieces of that many; no other is cut. Each piece goes where the sum, over all residual
gaps, of the squared number of open sequences with that gap becomes smallest; opening a sequence is one of the choices until as many are
open as the tokens need at least, and from then on only where no open one has room. Pieces are placed longest first.

The plan is made from the histogram of lengths, at most ``capacity`` numbers whatever the corpus size. Where there are more pieces
than ``PLANNED``, each placement is of as many pieces at once as make the number of placements ``PLANNED``; what the
division leaves over is placed in the same way, in smaller units, into the sequences open by then. Work and plan are so bounded
by ``PLANNED`` times the logarithm of the corpus. Pieces then find their places by rank, as in ``packing``.

Defined results: null text is an empty document and still has its closing token; repeated rows (also of
a repeated doc_id) are placed each, pieces of equal length by doc_id and start; a null doc_id is kept; an empty table gives an
empty result; texts of any length are read whole; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import checkpointed
from tessera.llm.packing import Patterns, assign_sequences
from tessera.llm.tokens import token_pieces

CAPACITY = 4096
#: Placements of one round of the plan.
PLANNED = 100_000


class OpenSequences:
    """Sequences with room, by gap: each entry is a pattern of lengths and the number of sequences that hold it."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.by_gap: dict[int, list[tuple[tuple[int, ...], int]]] = {}
        self.full: Patterns = []
        self.opened = 0

    def add(self, pattern: tuple[int, ...], gap: int, count: int) -> None:
        if gap:
            self.by_gap.setdefault(gap, []).append((pattern, count))
        else:
            self.full.append((pattern, count))

    def take(self, gap: int, count: int) -> tuple[int, ...]:
        """The pattern of ``count`` sequences with that gap, which are no longer open with it."""
        entries = self.by_gap[gap]
        at = next(i for i in range(len(entries) - 1, -1, -1) if entries[i][1] >= count)
        pattern, held = entries.pop(at)
        if held > count:
            entries.insert(at, (pattern, held - count))
        return pattern

    def counts(self, unit: int) -> np.ndarray:
        """How often ``unit`` sequences of one pattern are open, by gap."""
        out = np.zeros(self.capacity + 1, dtype=np.int64)
        for gap, entries in self.by_gap.items():
            out[gap] = sum(n // unit for _, n in entries)
        return out

    def patterns(self) -> Patterns:
        return self.full + [entry for gap in sorted(self.by_gap) for entry in self.by_gap[gap]]


def best_gap(counts: np.ndarray, length: int, may_open: bool) -> int:
    """The gap, of those with room for ``length``, that leaves the least sum of squared counts (the smallest of equals); the capacity stands for a
    new sequence. ``counts`` has the open sequences by gap."""
    capacity = len(counts) - 1
    gaps = np.flatnonzero(counts[length:capacity]) + length
    best, growth = capacity, None
    if len(gaps):
        change = 2 * (counts[gaps - length] - counts[gaps]) + 2
        if gaps[0] == length:
            change[0] = 1 - 2 * counts[length]  # a full sequence is not counted
        at = int(change.argmin())
        best, growth = int(gaps[at]), int(change[at])
    if growth is None or (may_open and 2 * int(counts[capacity - length]) + 1 < growth):
        return capacity
    return best


def sum_of_squares(histogram: dict[int, int], capacity: int = CAPACITY, planned: int = PLANNED) -> Patterns:
    """Patterns (lengths in order of placing, number of sequences) that hold a histogram of lengths."""
    sequences = OpenSequences(capacity)
    left = dict(histogram)
    tokens = capacity * left.get(capacity, 0)  # of all pieces that are placed by the end of a round
    if whole := left.pop(capacity, 0):
        sequences.add((capacity,), 0, whole)
        sequences.opened += whole
    while left:
        unit = -(-sum(left.values()) // planned)
        counts = sequences.counts(unit)
        tokens += sum(length * (n - n % unit) for length, n in left.items())
        needed = -(-tokens // capacity)
        for length in sorted(left, reverse=True):
            for _ in range(left[length] // unit):
                gap = best_gap(counts, length, sequences.opened + unit <= needed)
                if gap == capacity:
                    pattern: tuple[int, ...] = ()
                    sequences.opened += unit
                else:
                    pattern = sequences.take(gap, unit)
                    counts[gap] -= 1
                sequences.add((*pattern, length), gap - length, unit)
                counts[gap - length] += gap > length
        left = {length: n % unit for length, n in left.items() if n % unit}
    return sequences.patterns()


def pack_whole(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, doc_tokens, ids_crc32, sequence_id, offset), one row for each piece.

    The pieces' figures are checkpointed, so the texts are tokenized once; ``packing.packed_ids`` with ``plan_for=sum_of_squares`` joins ids to places.
    """
    figures = checkpointed(token_pieces(docs, tokenizer_path, capacity, with_ids=False))
    placed = assign_sequences(figures, capacity, plan_for=sum_of_squares)
    return placed.select("doc_id", (F.col("start") / capacity).cast("int").alias("piece"), "start", "length", "doc_tokens", "ids_crc32", "sequence_id", "offset")
