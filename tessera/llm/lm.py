"""Language-model scoring with a weighted backoff automaton over bytes, and unigram word baselines.

The model is an n-gram model of the UTF-8 bytes of the normalised text: words joined by single spaces, between start and
end marks (a line feed, which no normalised text holds). Bytes need no alphabet, and the probabilities of all byte strings sum to
one. The automaton is held as tables: a state for each context of the training part, up to ``ORDER - 1`` bytes, with the
weight of its failure arc, which leads to the context without its first byte; an arc for each n-gram, with its interpolated
(Witten-Bell) weight. Every n-gram is kept, whatever its count, so the automaton grows with the corpus.

N-grams are counted in Spark, lower orders by marginalising; weights are made order by order through joins. A text is traversed
from left to right, its state being its last five bytes, and adds up the log10 weights of the arcs that it takes. The arcs with the largest counts,
at most ``frequent_arcs`` of them, go to the workers as a sorted array; what else a text takes is joined with
the tables, where an arc that is not there is reached through failure arcs, one order at a time. The size of the array changes
no result.

Word counts are exact over the training part. Words with large counts, at most ``frequent_words`` of them, go to the
workers as a table; the other words of each text are joined with the counts.

Defined results: null text is empty (one token, the end); rows with null doc_id are neither held out nor learned from
(held_out null); repeated rows are scored each; an empty table gives an empty result; with nothing to learn from all
tokens are unknown and all bytes alike; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import built_once, checkpointed, crc_mod, new_key, row_slices

ORDER = 6
#: Arcs and words that workers hold; the rest is joined.
FREQUENT_ARCS, FREQUENT_WORDS = 2_000_000, 100_000
MARK = b"\n"
END_WORD = MARK  # never a word
STRETCH = 2_000_000


def normalised(text: str | None) -> tuple[list[bytes], bytes]:
    """The A-Z-lower-cased words, and the words joined by single spaces."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return words, b" ".join(words)


def stretches(lines: list[bytes], order: int = ORDER, size: int = STRETCH) -> Iterator[list[tuple[int, bytes]]]:
    """Groups of (number of the line, bytes): each line between its marks, a long one in pieces that begin with the state
    in which the piece before ends."""
    group, held = [], 0
    for i, line in enumerate(lines):
        line = MARK * (order - 1) + line + MARK
        for at in range(0, len(line) - order + 1, size):
            group.append((i, line[at : at + size + order - 1]))
            held += len(group[-1][1])
            if held >= size:
                yield group
                group, held = [], 0
    if group:
        yield group


def arcs_taken(group: list[tuple[int, bytes]], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The number of the line, and the n-gram as a number, of each arc that the pieces take; the last byte is the lowest."""
    line = np.frombuffer(b"".join(p for _, p in group), dtype=np.uint8)
    code = np.zeros(len(line) - order + 1, dtype=np.int64)
    for k in range(order):
        code = code << 8 | line[k : len(line) - order + 1 + k]
    sizes = np.array([len(p) for _, p in group])
    whole = np.ones(len(code), dtype=bool)
    for k in range(1, order):  # what runs over a piece's end into the next one
        whole[np.cumsum(sizes)[:-1] - k] = False
    return np.repeat([i for i, _ in group], sizes - order + 1), code[whole]


def merge_counts(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    codes = np.concatenate([a[0], b[0]])
    counts = np.concatenate([a[1], b[1]])
    kinds, inverse = np.unique(codes, return_inverse=True)
    return kinds, np.bincount(inverse, counts, len(kinds)).astype(np.int64)


def count_words(docs: DataFrame, flush: int = 400_000) -> DataFrame:
    """(word binary, n): exact counts over ``docs`` (doc_id, text); each text also counts one END_WORD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(c: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], names=["word", "n"])

        counts: Counter = Counter()
        for batch in row_slices(batches, 128):
            for text in batch.column(0).to_pylist():
                counts.update(normalised(text)[0])
                counts[END_WORD] += 1
            if len(counts) > flush:
                yield emit(counts)
                counts = Counter()
        yield emit(counts)

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def count_ngrams(docs: DataFrame, order: int = ORDER, flush: int = 3_000_000) -> DataFrame:
    """(code, n): the n-grams of ``docs`` (text) and how often each is taken."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
        held, size = [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            now = total
            for group in stretches(held, order):
                kinds, counts = np.unique(arcs_taken(group, order)[1], return_counts=True)
                now = merge_counts(now, (kinds, counts.astype(np.int64)))
            return now

        for batch in row_slices(batches, 128):
            for text in batch.column(0).to_pylist():
                held.append(normalised(text)[1])
                size += len(held[-1])
            if size > STRETCH:
                total, held, size = merged(), [], 0
            if len(total[0]) > flush:
                yield pa.RecordBatch.from_arrays([pa.array(total[0]), pa.array(total[1])], names=["code", "n"])
                total = (total[0][:0], total[1][:0])
        total = merged()
        yield pa.RecordBatch.from_arrays([pa.array(total[0]), pa.array(total[1])], names=["code", "n"])

    return docs.select("text").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def least_size(sizes: dict[int, int], room: int) -> int:
    """The least count, a power of two, that at most ``room`` of the things counted reach. sizes: number of them by floor(log2(count))."""
    least = 62
    for size in sorted(sizes, reverse=True):
        room -= sizes[size]
        if room < 0:
            break
        least = size
    return 2**least


def frequent_rows(rows: DataFrame, size: int) -> DataFrame:
    """The rows whose count ``n`` is at least the least power of two that at most ``size`` rows reach."""
    by_size = rows.groupBy(F.floor(F.log2("n")).cast("int").alias("size")).agg(F.count("*").alias("rows")).collect()  # at most 63
    return rows.where(F.col("n") >= F.lit(least_size({r["size"]: r["rows"] for r in by_size}, size)).cast("long"))


def _suffix(code: Column, k: int) -> Column:
    return code.bitwiseAND(F.lit((1 << 8 * k) - 1).cast("long"))


def automaton(grams: DataFrame, order: int = ORDER) -> tuple[dict[int, DataFrame], dict[int, DataFrame]]:
    """By n-gram length k: arcs (code, n, chance), and states (context, backoff) of k - 1 bytes. ``grams``: code, n."""
    counts, arcs, states = {order: grams}, {}, {}
    for k in range(order - 1, 0, -1):
        counts[k] = checkpointed(counts[k + 1].groupBy(_suffix(F.col("code"), k).alias("code")).agg(F.sum("n").alias("n")))
    for k in range(1, order + 1):
        rows = counts[k].withColumn("context", F.shiftright("code", 8))
        totals = rows.groupBy("context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        states[k] = checkpointed(totals.select("context", "total", (F.col("kinds") / (F.col("total") + F.col("kinds"))).alias("backoff")))
        rows = rows.join(states[k], "context").withColumn("shorter", _suffix(F.col("code"), k - 1) if k > 1 else F.lit(0).cast("long"))
        if k > 1:
            rows = rows.join(arcs[k - 1].select(F.col("code").alias("shorter"), F.col("chance").alias("below")), "shorter")
        else:
            rows = rows.withColumn("below", F.lit(1 / 256))
        # n / (total + kinds), as 1 - backoff is total / (total + kinds)
        arcs[k] = checkpointed(rows.select("code", "n", (F.col("n") / F.col("total") * (1 - F.col("backoff")) + F.col("backoff") * F.col("below")).alias("chance")))
    return arcs, states


def arc_weights(codes: DataFrame, arcs: dict[int, DataFrame], states: dict[int, DataFrame]) -> DataFrame:
    """(code, weight): log10 weights of the distinct n-grams ``codes``, through failure arcs where the automaton lacks one."""
    left, found = codes.select("code", F.lit(0.0).alias("so_far")), None
    for k in range(max(arcs), 0, -1):
        left = left.withColumn("at", _suffix(F.col("code"), k)).withColumn("context", F.shiftright("at", 8))
        tried = left.join(arcs[k].select(F.col("code").alias("at"), "chance"), "at", "left").join(states[k].select("context", "backoff"), "context", "left")
        tried = checkpointed(tried.select("code", "so_far", "chance", "backoff"))
        hit = tried.where(F.col("chance").isNotNull()).select("code", (F.col("so_far") + F.log10("chance")).alias("weight"))
        found = hit if found is None else found.unionByName(hit)
        left = tried.where(F.col("chance").isNull()).select("code", (F.col("so_far") + F.coalesce(F.log10("backoff"), F.lit(0.0))).alias("so_far"))
    return found.unionByName(left.select("code", (F.col("so_far") - math.log10(256)).alias("weight")))


def traverse(lines: list[bytes], codes: np.ndarray, weights: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
    """log10 weight of the arcs of each line that are in ``codes`` (ascending), and the others with how often each is taken."""
    score, rest = np.zeros(len(lines)), [[] for _ in lines]
    for group in stretches(lines, order):
        owner, taken = arcs_taken(group, order)
        kinds, inverse = np.unique(taken, return_inverse=True)
        at = np.minimum(np.searchsorted(codes, kinds), max(len(codes) - 1, 0))
        known = codes[at] == kinds if len(codes) else np.zeros(len(kinds), dtype=bool)
        weight = np.zeros(len(kinds))
        weight[known] = weights[at[known]]
        score += np.bincount(owner, weight[inverse], len(lines))
        other = ~known[inverse]
        pairs, counts = np.unique(np.stack([owner[other], taken[other]]), axis=1, return_counts=True)
        for i, code, n in zip(*pairs.tolist(), counts.tolist(), strict=True):
            rest[i].append((code, n))
    return score, rest


class Scorer:
    """Scores texts in a worker: arcs of the automaton, and the base figures of the frequent words."""

    def __init__(self, codes: np.ndarray, weights: np.ndarray, frequent: dict[bytes, int], n_tokens: int, n_kinds: int, order: int) -> None:
        self.codes, self.weights, self.order = codes, weights, order
        self.costs = {w: math.log10((c + 0.5) / (n_tokens + 0.5 * (n_kinds + 1))) for w, c in frequent.items()}

    def score(self, texts: list[str | None]) -> list[tuple[int, int, float, float, list[tuple[bytes, int]], list[tuple[int, int]]]]:
        """(n_tokens, known frequent tokens, their base score, score of frequent arcs, other words, other arcs) of each text."""
        figures, lines = [], []
        for text in texts:
            words, joined = normalised(text)
            lines.append(joined)
            counts = Counter(words)
            counts[END_WORD] += 1
            known, base, rare = 0, 0.0, []
            for w, c in counts.items():
                cost = self.costs.get(w)
                if cost is None:
                    rare.append((w, c))
                else:
                    known += c
                    base += c * cost
            figures.append((len(words) + 1, known, base, rare))
        scores, rest = traverse(lines, self.codes, self.weights, self.order)
        return [(n, k, b, float(s), w, r) for (n, k, b, w), s, r in zip(figures, scores, rest, strict=True)]


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, frequent_arcs: int = FREQUENT_ARCS, frequent_words: int = FREQUENT_WORDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row for each input row."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    training = rows.where(crc_mod("doc_id") != 1)
    words = checkpointed(count_words(training))
    n_tokens, n_kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    arcs, states = automaton(checkpointed(count_ngrams(training, order)), order)
    # as Arrow columns: rows as Python objects would take ten times the driver's memory
    held = frequent_rows(arcs[order], frequent_arcs).select("code", F.log10("chance").alias("weight")).toArrow().sort_by("code")
    frequent = frequent_rows(words, frequent_words).select("word", "n").toArrow()
    frequent = dict(zip(frequent["word"].to_pylist(), frequent["n"].to_pylist(), strict=True))
    shared, key = spark.sparkContext.broadcast((held["code"].to_numpy(), held["weight"].to_numpy(), frequent)), new_key()
    del held, frequent

    def listed(name: str, kind: T.DataType) -> T.StructField:
        return T.StructField(name, T.ArrayType(T.StructType([T.StructField("what", kind), T.StructField("c", T.LongType())])))

    schema = T.StructType(
        [T.StructField(n, T.LongType()) for n in ("doc_id", "row", "n_tokens", "known")]
        + [T.StructField("base", T.DoubleType()), T.StructField("score", T.DoubleType()), listed("words", T.BinaryType()), listed("arcs", T.LongType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        scorer = built_once("lm", key, lambda: Scorer(*shared.value, n_tokens, n_kinds, order))
        row = TaskContext.get().partitionId() << 40
        for batch in row_slices(batches, 512):
            n, known, base, score, *others = zip(*scorer.score(batch.column(1).to_pylist()), strict=True)
            lists = [pa.array([[{"what": w, "c": c} for w, c in r] for r in o], pa.list_(pa.struct([("what", k), ("c", pa.int64())]))) for o, k in zip(others, (pa.binary(), pa.int64()), strict=True)]
            columns = [pa.array(range(row, row + len(n)), pa.int64()), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, *lists], names=schema.names)
            row += len(n)

    scored = checkpointed(rows.mapInArrow(run, schema))
    floor = math.log10(0.5 / (n_tokens + 0.5 * (n_kinds + 1)))
    cost = F.log10((F.col("n") + 0.5) / F.lit(n_tokens + 0.5 * (n_kinds + 1)))
    rare = scored.select("row", F.inline("words")).join(words.withColumnRenamed("word", "what"), "what")
    rare = rare.select("row", F.col("c").alias("more"), (F.col("c") * (cost - F.lit(floor))).alias("gain"), F.lit(0.0).alias("weight"))
    other = scored.select("row", F.inline("arcs")).withColumnRenamed("what", "code")
    weights = arc_weights(other.select("code").distinct(), arcs, states)
    other = other.join(weights, "code").select("row", F.lit(0).cast("long").alias("more"), F.lit(0.0).alias("gain"), (F.col("c") * F.col("weight")).alias("weight"))
    gains = rare.unionByName(other).groupBy("row").agg(*[F.sum(c).alias(c) for c in ("more", "gain", "weight")])
    out = scored.select("doc_id", "row", "n_tokens", "known", "base", "score").join(gains, "row", "left")
    nothing = F.lit(0.0)
    return out.select(
        "doc_id", (crc_mod("doc_id") == 1).alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(n_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + (F.col("n_tokens") - F.col("known")) * F.lit(floor) + F.coalesce("gain", nothing)).alias("base_score"),
        (F.col("score") + F.coalesce("weight", nothing)).alias("score"),
    )
