"""Quality rules: base counts, and divergence of a text's distributions from language references.

A language reference is the mean, over all documents labelled with the language, of the shares of character classes and of the
shares of the language's common words (with one share for all other words). A text's distance to it is the
Jensen-Shannon distance (base 2, 0 to 1); the least over the languages counts. Texts of fewer than ``MIN_WORDS`` words
are too short for a verdict from shares and are kept if the base rules keep them.

The lists of common words are counted over all labelled texts, as the shares of the references are means over all of them.

Defined results: null text has no words and base_failed; repeated rows are judged each; without labelled documents there is no
reference and the base rules decide alone; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import built_once, new_key, row_slices

COMMON_WORDS = 40
#: Different words that a task counts before it hands them on.
COUNTED_AT_ONCE = 200_000
MIN_WORDS = 50
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.25, 0.45
WINDOW = 5
UNICODE = 0x110000
WHITE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
#: Character classes: lower and upper case letters, other letters, digits, white space, marks of prose, anything else.
N_CLASSES = 7
PROSE_MARKS = ".,;:!?'\"()-"


def class_table() -> np.ndarray:
    table = np.full(UNICODE, 6, dtype=np.uint8)
    for i in range(UNICODE):
        c = chr(i)
        if c.isalpha():
            table[i] = 0 if c.islower() else 1 if c.isupper() else 2
        elif c.isdigit():
            table[i] = 3
        elif c.isspace():
            table[i] = 4
    for c in PROSE_MARKS:
        table[ord(c)] = 5
    return table


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in the windows that occur twice or more, each word once."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    kinds: dict[bytes, int] = {}
    ids = np.array([kinds.setdefault(w, len(kinds)) for w in words], dtype=np.uint64)
    mixed = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    key = np.zeros(n, dtype=np.uint64)
    for k in range(window):
        key = key * np.uint64(0xBF58476D1CE4E5B9) + mixed[k : k + n]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    a, b = order[1:][same], order[:-1][same]
    starts = np.zeros(n, dtype=bool)
    if all((ids[a + k] == ids[b + k]).all() for k in range(window)):
        starts[a] = starts[b] = True
    else:  # two windows share a key by chance
        line = ids.tolist()
        windows = [tuple(line[i : i + window]) for i in range(n)]
        counts = Counter(windows)
        starts[:] = [counts[w] > 1 for w in windows]
    covered = np.zeros(len(words), dtype=bool)
    for k in range(window):
        covered[k : k + n] |= starts
    return int(covered.sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    if "\n" not in text:
        return 0
    lines = [x for x in text.encode("utf-8", "surrogatepass").split(b"\n") if x.split()]
    return len(lines) - len(set(lines))


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of the rows of p to the row q."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=-1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=-1)
    return np.sqrt(np.clip((left + right) / 2, 0, 1))


class Histograms:
    """Shares of classes and common words of texts."""

    def __init__(self, common: dict[str, list[bytes]]) -> None:
        self.languages = sorted(common)
        self.classes = class_table()
        self.places: dict[bytes, list[tuple[int, int]]] = {}
        for i, lang in enumerate(self.languages):
            for k, w in enumerate(common[lang]):
                self.places.setdefault(w, []).append((i, k))

    def of(self, text: str, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Shares (classes) and (languages, common words and others)."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        chars = np.bincount(self.classes[points], minlength=N_CLASSES) / max(1, len(points))
        counts = np.zeros((len(self.languages), COMMON_WORDS + 1))
        n = max(1, len(words))
        tally = Counter(words)
        for w in tally.keys() & self.places.keys():
            for i, k in self.places[w]:
                counts[i, k] += tally[w]
        counts[:, -1] = n - counts.sum(axis=1)
        return chars, counts / n


def plain_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def common_words(labelled: DataFrame) -> dict[str, list[bytes]]:
    """The most frequent A-Z-lower-cased words of each language, counted over all of its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter[bytes]] = {}

        def flushed() -> pa.RecordBatch:
            rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
            counts.clear()
            columns = list(zip(*rows, strict=True)) or [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.int64())], names=["lang", "word", "n"])

        for batch in row_slices(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts.setdefault(lang, Counter()).update(text.encode("utf-8", "surrogatepass").lower().split())
            if sum(map(len, counts.values())) > COUNTED_AT_ONCE:
                yield flushed()
        yield flushed()

    counted = labelled.select("lang", "text").mapInArrow(run, "lang string, word binary, n long")
    totals = counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    out: dict[str, list[bytes]] = {}
    for r in totals.withColumn("at", F.row_number().over(order)).where(F.col("at") <= COMMON_WORDS).orderBy("lang", "at").collect():  # COMMON_WORDS rows a language
        out.setdefault(r["lang"], []).append(bytes(r["word"]))
    return out


def references(labelled: DataFrame, common: dict[str, list[bytes]]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """By language, the mean shares of classes and of its common words over all labelled documents with MIN_WORDS words."""
    shared, key = labelled.sparkSession.sparkContext.broadcast(common), new_key()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = built_once("quality", key, lambda: Histograms(shared.value))
        sums = {lang: np.zeros(1 + N_CLASSES + COMMON_WORDS + 1) for lang in tool.languages}
        for batch in row_slices(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = [w.lower() for w in plain_words(text)]
                if lang in sums and len(words) >= MIN_WORDS:
                    chars, shares = tool.of(text, words)
                    sums[lang] += np.concatenate([[1], chars, shares[tool.languages.index(lang)]])
        rows = [(lang, at, float(x)) for lang, v in sums.items() for at, x in enumerate(v)]
        columns = list(zip(*rows, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.float64())], names=["lang", "at", "x"])

    sums = labelled.select("lang", "text").mapInArrow(run, "lang string, at int, x double").groupBy("lang", "at").agg(F.sum("x").alias("x"))
    out: dict[str, np.ndarray] = {lang: np.zeros(1 + N_CLASSES + COMMON_WORDS + 1) for lang in common}
    for r in sums.collect():  # about fifty rows a language
        out[r["lang"]][r["at"]] = r["x"]
    return {lang: (v[1 : 1 + N_CLASSES] / v[0], v[1 + N_CLASSES :] / v[0]) for lang, v in out.items() if v[0]}


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, char_distance, word_distance)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    labelled = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    common = common_words(labelled)
    refs = references(labelled, common)
    context, key = docs.sparkSession.sparkContext, new_key()
    shared, shared_refs = context.broadcast({lang: common[lang] for lang in refs}), context.broadcast(refs)
    longs = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    schema = T.StructType(
        [T.StructField(n, T.LongType()) for n in longs]
        + [T.StructField(n, T.BooleanType()) for n in ("base_failed", "kept")]
        + [T.StructField(n, T.DoubleType()) for n in ("char_distance", "word_distance")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, refs = built_once("quality", key, lambda: Histograms(shared.value)), shared_refs.value
        for batch in row_slices(batches):
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = text or ""
                raw = text.encode("utf-8", "surrogatepass")
                words = raw.split()
                n, repeats = len(words), repeated_words(words)
                failed = n < 10 or 100 * repeats > 20 * n
                char_distance = word_distance = None
                if n >= MIN_WORDS and refs:
                    chars, shares = tool.of(text, [w.lower() for w in words])
                    char_distance = min(float(js_distance(chars, refs[lang][0])) for lang in tool.languages)
                    word_distance = min(float(js_distance(shares[i], refs[lang][1])) for i, lang in enumerate(tool.languages))
                near = char_distance is None or (char_distance <= MAX_CHAR_DISTANCE and word_distance <= MAX_WORD_DISTANCE)
                whites = len(raw) - len(raw.translate(None, WHITE))
                symbols = len(raw) - len(raw.translate(None, SYMBOLS))
                out.append((doc_id, n, len(text) - whites, symbols, duplicate_lines(text), repeats, failed, not failed and near, char_distance, word_distance))
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i < 6 else pa.bool_() if i < 8 else pa.float64()) for i, c in enumerate(columns)], names=schema.names)

    return rows.select("doc_id", "text").mapInArrow(run, schema)
