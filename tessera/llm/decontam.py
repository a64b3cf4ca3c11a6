"""Benchmark decontamination: every training passage queries a BM25 index of the test items.

Items are split by length class (up to 8, 16, 32, ... words). For a class of at most L words the passages of a
document are its windows of 2L words every L words, so any run of L words lies whole in one passage. Impacts
are BM25 weights divided by the item's score against itself: a passage that contains the item scores 1, and
one threshold serves all items. Block-max WAND retrieves every item at or above the threshold, block at a time:
sums of the terms' largest impacts bound first runs of items, for all passages of a document at once, then
blocks of posting lists; lists are read only for passages with a block that can reach the threshold. A retrieved item counts as leaked if at least
``overlap`` of the five-word shingles of its question and of its answer occur in the passage.

The index is broadcast in blocks of at most ``block_items`` items; each block is a pass over the documents,
which are neither shuffled nor sampled. Collection statistics are over all items.

Defined results: null or wordless texts have no passages and are clean; items without words are never
retrieved; an item has the text up to its last question mark as question and the rest as answer, or two
halves where there is no question mark or nothing after it; repeated rows are judged each; empty tables give empty
results; other columns are ignored by ``leaks`` and kept by ``without_leaks``.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import row_slices

K1, B = 1.2, 0.75
SHINGLE = 5
THRESHOLD, OVERLAP = 0.6, 0.8
BLOCK_ITEMS, POSTING_BLOCK, SPANS = 20_000, 64, 32
SLACK = 1e-9
WORD = re.compile(r"\w+")
HIT = T.StructType([T.StructField("item_id", T.LongType()), *(T.StructField(n, T.DoubleType()) for n in ("score", "question_overlap", "answer_overlap"))])


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def shingles(words: list[str]) -> set[tuple[str, ...]]:
    if len(words) <= SHINGLE:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)}


def question_and_answer(text: str | None) -> tuple[list[str], list[str]]:
    """The words of an item's two parts."""
    text = text or ""
    at = text.rfind("?") + 1
    if at and words_of(text[at:]) and words_of(text[:at]):
        return words_of(text[:at]), words_of(text[at:])
    words = words_of(text)
    half = (len(words) + 1) // 2
    return words[:half], words[half:]


@dataclass
class LengthClass:
    """Posting lists of the items of up to ``longest`` words; items are numbered in the order of adding.

    ``postings`` has (items, impacts) by term and ``tops`` (blocks, largest impact in each). ``spans`` has for each
    term the largest impact in each of at most SPANS runs of items.
    """

    longest: int
    items: list[tuple[int, list[str], list[str]]] = field(default_factory=list)
    postings: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    tops: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    spans: np.ndarray | None = None


class ItemIndex:
    """BM25 impacts of a block of items, by length class, over one vocabulary."""

    def __init__(self, items: list[tuple[int, str]], df: dict[str, int], n_items: int, mean_length: float) -> None:
        self.vocabulary: dict[str, int] = {}
        self.classes: dict[int, LengthClass] = {}
        raw: dict[int, dict[int, list[tuple[int, float]]]] = defaultdict(lambda: defaultdict(list))
        for item_id, text in sorted(items, key=lambda x: (x[0] is None, x[0])):
            words = words_of(text)
            if not words:
                continue
            longest = max(8, 1 << (len(words) - 1).bit_length())
            group = self.classes.setdefault(longest, LengthClass(longest))
            weights = {
                w: np.log1p((n_items - df[w] + 0.5) / (df[w] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * len(words) / mean_length))
                for w, c in Counter(words).items()
            }
            own = sum(weights.values())
            for w, x in weights.items():
                raw[longest][self.vocabulary.setdefault(w, len(self.vocabulary))].append((len(group.items), x / own))
            group.items.append((item_id, *question_and_answer(text)))
        for longest, group in self.classes.items():
            n = len(group.items)
            group.spans = np.zeros((len(self.vocabulary) + 1, min(n, SPANS)))
            for term, rows in raw[longest].items():
                ids, impacts = np.array([i for i, _ in rows]), np.array([x for _, x in rows])
                group.postings[term] = (ids, impacts)
                blocks, at = np.unique(ids // POSTING_BLOCK, return_index=True)
                group.tops[term] = (blocks, np.maximum.reduceat(impacts, at))
                np.maximum.at(group.spans[term], ids * group.spans.shape[1] // n, impacts)


def block_max_wand(group: LengthClass, terms: list[int], threshold: float) -> list[tuple[int, float]]:
    """(item number, score) of all items whose impacts over the distinct ``terms`` sum to the threshold or more.

    Block at a time: the largest impacts of the terms' blocks bound every item of a block; posting lists are
    read only if some block can reach the threshold.
    """
    terms = [t for t in terms if t in group.postings]
    if not terms:
        return []
    blocks, tops = zip(*[group.tops[t] for t in terms], strict=True)
    bounds = np.bincount(np.concatenate(blocks), np.concatenate(tops))
    if bounds.max() < threshold - SLACK:
        return []
    ids, impacts = zip(*[group.postings[t] for t in terms], strict=True)
    ids, impacts = np.concatenate(ids), np.concatenate(impacts)
    live = bounds[ids // POSTING_BLOCK] >= threshold - SLACK
    scores = np.bincount(ids[live], impacts[live])
    return [(int(i), float(scores[i])) for i in np.flatnonzero(scores >= threshold - SLACK)]


def text_hits(text: str | None, index: ItemIndex, threshold: float, overlap: float) -> list[tuple[int, float, float, float]]:
    """(item_id, score, question_overlap, answer_overlap) of the leaked items, each from its best passage."""
    words = words_of(text)
    if not words:
        return []
    get, none = index.vocabulary.get, len(index.vocabulary)
    ids = np.fromiter((get(w, none) for w in words), dtype=np.int64, count=len(words))
    best: dict[tuple[int, int], tuple[float, float, float]] = {}
    for group in index.classes.values():
        starts = np.arange(0, max(1, len(words) - group.longest), group.longest)
        ends = np.minimum(starts + 2 * group.longest, len(words))
        strides = np.add.reduceat(group.spans[ids], starts, axis=0)  # the last stride runs to the end
        bounds = strides.copy()
        bounds[:-1] += strides[1:]
        for w in np.flatnonzero(bounds.max(axis=1) >= threshold - SLACK):
            a, b = int(starts[w]), int(ends[w])
            terms = np.unique(ids[a:b])
            if group.spans[terms].sum(axis=0).max() < threshold - SLACK:
                continue
            passage = None
            for number, score in block_max_wand(group, terms[terms < none].tolist(), threshold):
                passage = passage or shingles(words[a:b])
                item_id, question, answer = group.items[number]
                shares = []
                for part in (question, answer):
                    wanted = shingles(part)
                    if wanted and len(part) < SHINGLE:
                        n = len(part)
                        have = {tuple(words[i : i + n]) for i in range(a, b - n + 1)}
                        shares.append(len(wanted & have) / len(wanted))
                    else:
                        shares.append(len(wanted & passage) / len(wanted) if wanted else 1.0)
                if min(shares) >= overlap:
                    key = (group.longest, number)
                    best[key] = max(best.get(key, (0.0, 0.0, 0.0)), (score, *shares))
    return [(index.classes[g].items[n][0], *v) for (g, n), v in sorted(best.items())]


def index_blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text", block_items: int = BLOCK_ITEMS) -> Iterator[ItemIndex]:
    """The items' indexes, one block at a time; document frequencies and lengths are those of all items."""
    rows = items.select(F.col(id_col).cast("long").alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)(\w+)"), 1)
    n_items, mean_length = rows.agg(F.count("*"), F.avg(F.size(words))).first()
    if not n_items or not mean_length:
        return
    df = rows.select(F.explode(F.array_distinct(words)).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    n_blocks = -(-n_items // block_items)
    blocked = rows.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)))
    for block in range(n_blocks):
        part = blocked.where(F.col("block") == block)
        texts = [(r["item_id"], r["text"]) for r in part.select("item_id", "text").collect()]  # about block_items at most
        used = part.select(F.explode(F.array_distinct(words)).alias("word")).distinct()
        known = {r["word"]: r["df"] for r in df.join(used, "word", "left_semi").collect()}
        missing = {w for _, t in texts for w in words_of(t)} - known.keys()
        yield ItemIndex(texts, known | dict.fromkeys(missing, 1), n_items, mean_length)


def _hits(docs: DataFrame, text_col: str, keep: list[str], index: ItemIndex, threshold: float, overlap: float, out: str) -> DataFrame:
    """``keep`` columns of ``docs`` and the array column ``out`` of the text's hits in this index."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(out, T.ArrayType(HIT))])
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches):
            found = [
                [dict(zip(HIT.names, h, strict=True)) for h in text_hits(t, shared.value, threshold, overlap)]
                for t in batch.column(batch.num_columns - 1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, kind)], names=[*keep, out])

    return docs.select(*keep, F.col(text_col).alias("_passage_text")).mapInArrow(run, schema)


def leaks(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP
) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap): the items that each document leaks."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = docs.sparkSession.createDataFrame([], T.StructType([T.StructField("doc_id", T.LongType()), *HIT.fields]))
    for index in index_blocks(items):
        found = _hits(rows, "text", ["doc_id"], index, threshold, overlap, "hits")
        out = out.unionByName(found.select("doc_id", F.inline("hits")))
    return out


def without_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text leaks no item."""
    out, clean = "_tessera_hits", docs
    for index in index_blocks(items):
        clean = _hits(clean, text_col, docs.columns, index, threshold, overlap, out).where(F.size(out) == 0).drop(out)
    return clean
