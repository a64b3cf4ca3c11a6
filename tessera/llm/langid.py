"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A document is parsed against it into longest matches:
the automaton reads on while the phrase still occurs in the language's text and starts a new phrase where it does
not. The number of phrases, times the bits that name a place in the language's text, over the document's length
estimates the cross entropy; the language that needs the least wins.

Letters are folded to classes, one for each letter of the labelled text in lower case; runs of anything but letters are one
separator. A letter that a language's text lacks matches nothing there. Documents are parsed in blocks of ``BLOCK`` classes, side by side with others, and the
phrases that the cuts between blocks would add are taken back: the parse that runs on from the block before is
followed until it starts a phrase where the block's own parse does, from where both are the same. The count is that of an unbroken parse.

A text may be in none of the languages. Labelled texts that were not learned from tell how many bits a letter a language's own texts need; a
text that needs ``LIMIT`` deviations more, or most of whose letters the language lacks, fits none (``known`` is false, its score small). Random letters differ by 7
deviations and more at 60 letters and by 15 at 300; texts of a few words are seldom told.

Learning uses a bounded sample, a parameter of the fit: the ``max_languages`` languages with most labelled texts (ties by name), for
each at most ``sample_docs`` texts to learn from and as many to measure with, the one with the least hash in each hash bucket, and ``slice_chars`` code points from the middle of each.
Predictions read whole texts.

Defined results: ``und`` with score 0 where text is null or has no letter, or where nothing is labelled; ties go to
the first language by name; repeated rows are predicted each; held_out is null for a null id, and such rows are not
learned from; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import built_once, crc_mod, new_key, row_slices

SAMPLE_DOCS, SLICE_CHARS, MAX_LANGUAGES = 64, 256, 256
#: Classes up to which a language's parsing table is dense.
DENSE_CLASSES = 256
#: Deviations over a language's usual bits a letter at which a text is in no known language, and the share that is left of its score.
LIMIT, MISFIT = 9.0, 0.01
#: Texts, and letters of a text, from which a language's usual bits are measured, and the least deviation that is taken.
LEAST_MEASURED, LEAST_LETTERS, LEAST_DEVIATION = 8, 50, 0.2
OTHER, SEPARATOR = 0, 1
BLOCK = 512
UNDETERMINED = "und"
UNICODE = 0x110000


Samples = dict[str, list[str]]


def labelled_sample(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, slice_chars: int = SLICE_CHARS, max_languages: int = MAX_LANGUAGES) -> Samples:
    """The texts to learn from alone."""
    return labelled_samples(labelled, sample_docs, slice_chars, max_languages, 1)[0]


def labelled_samples(
    labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, slice_chars: int = SLICE_CHARS, max_languages: int = MAX_LANGUAGES, n_uses: int = 2
) -> tuple[Samples, Samples]:
    """By language, for at most ``max_languages``, slices of at most ``sample_docs`` distinct texts to learn from, and of as many others to measure
    with. ``labelled``: lang, text."""
    middle = F.greatest(F.lit(1), F.floor((F.length("text") - slice_chars) / 2) + 1).cast("int")
    labelled = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    most = labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages)
    rows = labelled.where(F.col("lang").isin([r["lang"] for r in most.collect()])).select(
        "lang", F.xxhash64("text").alias("h"), F.xxhash64(F.xxhash64("text"), F.lit(1)).alias("g"), F.substring(F.col("text"), middle, F.lit(slice_chars)).alias("piece")
    )
    uses = F.explode(F.array(*[F.struct(F.lit(use).alias("use"), F.pmod(hashed, F.lit(sample_docs)).alias("bucket"), F.struct(hashed.alias("by"), F.col("h")).alias("of")) for use, hashed in enumerate((F.col("h"), F.col("g"))[:n_uses])]))
    chosen = rows.select("lang", uses.alias("u")).groupBy("lang", "u.use", "u.bucket").agg(F.min("u.of").alias("of")).select("lang", "use", F.col("of.h").alias("h"))
    pieces = rows.join(F.broadcast(chosen), ["lang", "h"])  # twice sample_docs rows a language at most
    pieces = pieces.groupBy("lang", "use", "h").agg(F.min("piece").alias("piece"))
    out: tuple[Samples, Samples] = ({}, {})
    learned = set()
    for r in sorted(pieces.collect(), key=lambda r: (r["use"], r["lang"], r["h"])):  # twice sample_docs rows a language at most
        if r["use"] == 0:
            learned.add((r["lang"], r["h"]))
        if r["use"] == 0 or (r["lang"], r["h"]) not in learned:
            out[r["use"]].setdefault(r["lang"], []).append(r["piece"])
    return out


class SuffixAutomaton:
    """The suffix automaton of a sequence of small integers (Blumer et al., 1985)."""

    def __init__(self, line: list[int]) -> None:
        self.next: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in line:
            new = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    twin = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = twin
                        p = link[p]
                    link[q] = link[new] = twin
            last = new


class DenseTable:
    """For state and class: twice the next state, plus one where a new phrase starts with the class."""

    def __init__(self, start: np.ndarray, states: int, keys: np.ndarray, values: np.ndarray) -> None:
        table = np.tile(start, states)
        table[keys[keys >= 0]] = values[keys >= 0]
        self.width, self.flat = len(start), table

    def step(self, state: np.ndarray, read: np.ndarray) -> np.ndarray:
        return self.flat[state * self.width + read]

    def phrases(self, line: np.ndarray) -> int:
        """The phrases of one line, read from end to end."""
        flat, width, s, found = memoryview(self.flat), self.width, 0, 0
        for c in line.tolist():
            arc = flat[s * width + c]
            found += arc & 1
            s = arc >> 1
        return found


class SparseTable:
    """The same for many classes: only arcs that go on are held, in order."""

    def __init__(self, start: np.ndarray, keys: np.ndarray, values: np.ndarray) -> None:
        self.width, self.start, self.keys, self.values = len(start), start, keys, values

    def step(self, state: np.ndarray, read: np.ndarray) -> np.ndarray:
        key = state * self.width + read
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], self.start[read])

    def phrases(self, line: np.ndarray) -> int:
        arcs, start, width, s, found = dict(zip(self.keys.tolist(), self.values.tolist(), strict=True)), self.start.tolist(), self.width, 0, 0
        for c in line.tolist():
            arc = arcs.get(s * width + c, start[c])
            found += arc & 1
            s = arc >> 1
        return found


def parsing_table(line: list[int], width: int) -> DenseTable | SparseTable:
    """The parsing table of a language's text over ``width`` classes; dense for alphabets, sparse for scripts of syllables or words."""
    arcs = SuffixAutomaton(line).next
    start = np.ones(width, dtype=np.int32)
    for c, s in arcs[0].items():
        if c != OTHER:
            start[c] = 2 * s + 1
    rows = sorted((state * width + c, 2 * s) for state, out in enumerate(arcs[1:], 1) for c, s in out.items() if c != OTHER) or [(-1, 0)]
    keys, values = (np.array([r[k] for r in rows], dtype=d) for k, d in ((0, np.int64), (1, np.int32)))
    return DenseTable(start, len(arcs), keys, values) if width <= DENSE_CLASSES else SparseTable(start, keys, values)


class LanguageModel:
    """Parsing tables of the languages' suffix automata; built in each worker from the samples."""

    def __init__(self, samples: Samples, measured: Samples | None = None) -> None:
        self.languages = sorted(samples)
        counts = {lang: Counter(c for p in samples[lang] for c in p.lower() if c.isalpha()) for lang in self.languages}
        letters = sorted(set().union(*counts.values()))
        self.letter = np.fromiter((chr(i).isalpha() for i in range(UNICODE)), dtype=bool, count=UNICODE)
        self.classes = np.where(self.letter, OTHER, SEPARATOR).astype(np.int32)
        for i, c in enumerate(letters):
            for form in {c, c.upper()}:
                if len(form) == 1:
                    self.classes[ord(form)] = i + 2
        place = {c: i + 2 for i, c in enumerate(letters)}
        self.own, self.tables, self.bits = [], [], []
        for lang in self.languages:
            used = sorted(counts[lang])
            own = np.zeros(len(letters) + 2, dtype=np.int32)  # a language's own number of each class
            own[SEPARATOR] = SEPARATOR
            own[[place[c] for c in used]] = np.arange(2, len(used) + 2)
            line = [int(own[c]) for p in samples[lang] for c in (*self.fold(p)[0], OTHER)]
            self.own.append(own)
            self.tables.append(parsing_table(line, len(used) + 2))
            self.bits.append(np.log2(max(2, len(line))))
        self.usual = [self._usual(i, (measured or {}).get(lang, [])) for i, lang in enumerate(self.languages)]

    def _usual(self, i: int, texts: list[str]) -> tuple[float, float, float] | None:
        """Mean and deviation of the bits a letter of texts in language ``i``, and the letters of such a text; None if too few are long enough."""
        folded = [f for f in map(self.fold, texts) if f[1] >= LEAST_LETTERS]
        if len(folded) < LEAST_MEASURED:
            return None
        letters = np.array([n for _, n in folded])
        bits = self.phrases([f for f, _ in folded])[:, i] * self.bits[i] / letters
        return float(bits.mean()), float(max(bits.std(), LEAST_DEVIATION)), float(letters.mean())

    def fits(self, i: int, folded: np.ndarray, letters: int, bits: float) -> bool:
        """Whether a text may be in language ``i`` at all: most of its letters are the language's, and its bits a letter are no more than ``LIMIT`` deviations
        over those of the language's own texts. A text shorter than these varies more, as the root of its length. Where too few texts could be measured, all fit."""
        if self.usual[i] is None:
            return True
        lettered = folded != SEPARATOR
        if 2 * np.count_nonzero(self.own[i][folded[lettered]] == OTHER) > np.count_nonzero(lettered):
            return False
        mean, deviation, usual_letters = self.usual[i]
        return bits / letters <= mean + LIMIT * deviation * max(1.0, usual_letters / letters) ** 0.5

    def fold(self, text: str) -> tuple[np.ndarray, int]:
        """Classes of the text with runs of separators as one, and the number of letters."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        classes = self.classes[points]
        gap = classes == SEPARATOR
        keep = np.ones(len(classes), dtype=bool)
        keep[1:] = ~(gap[1:] & gap[:-1])
        return classes[keep], int(self.letter[points].sum())

    def phrases(self, lines: list[np.ndarray], block: int = BLOCK) -> np.ndarray:
        """Phrases of each line against each language, (lines, languages)."""
        lengths = np.array([len(x) for x in lines])
        cuts = -(-lengths // block)
        owner = np.repeat(np.arange(len(lines)), cuts)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        begins = (np.cumsum(lengths) - lengths)[owner] + at * block
        sizes = np.minimum(block, lengths[owner] - at * block)
        order = np.argsort(-sizes, kind="stable")
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        later = np.flatnonzero(at)
        here, before = place[later], place[later - 1]  # a line's blocks stand in a row until sorted
        last = (at == cuts[owner] - 1)[order]
        begins, sizes, owner = begins[order], sizes[order], owner[order]
        whole = np.concatenate(lines)
        out = np.zeros((len(lines), len(self.tables)))
        for i, (own, table) in enumerate(zip(self.own, self.tables, strict=True)):
            out[:, i] = self._phrases(own[whole].astype(np.int64), table, begins, sizes, owner, last, here, before, len(lines))
        return out

    @staticmethod
    def _phrases(line: np.ndarray, table: DenseTable | SparseTable, begins: np.ndarray, sizes: np.ndarray, owner: np.ndarray, last: np.ndarray, here: np.ndarray, before: np.ndarray, n: int) -> np.ndarray:
        state, count = np.zeros(len(owner), dtype=np.int64), np.zeros(len(owner), dtype=np.int64)
        running = len(owner)
        for k in range(int(sizes[0]) if len(sizes) else 0):
            while sizes[running - 1] <= k:
                running -= 1
            arc = table.step(state[:running], line[begins[:running] + k])
            count[:running] += arc & 1
            state[:running] = arc >> 1
        # the parse that runs on from the block before (on) beside the block's own (mine), until they start a phrase together
        on, mine, broken, k = state[before], np.zeros(len(here), dtype=np.int64), np.zeros(n, dtype=bool), 0
        while len(here):
            ended = sizes[here] <= k
            if ended.any():
                broken[owner[here[ended & ~last[here]]]] = True  # the block after it was given the wrong parse to go on with
                here, on, mine = here[~ended], on[~ended], mine[~ended]
            read = line[begins[here] + k]
            a, b = table.step(on, read), table.step(mine, read)
            count[here] += (a & 1) - (b & 1)
            apart = ~((a & b & 1).astype(bool))
            here, on, mine, k = here[apart], a[apart] >> 1, b[apart] >> 1, k + 1
        found = np.bincount(owner, count, n)
        for i in np.flatnonzero(broken):  # a phrase as long as a block: this line's parse is followed from end to end
            mine = owner == i
            found[i] = table.phrases(line[begins[mine].min() : (begins[mine] + sizes[mine]).max()])
        return found

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """The language of each text, the share of its probability among all languages, and whether the text fits it."""
        folded = [self.fold(t or "") for t in texts]
        languages, scores, known = [UNDETERMINED] * len(texts), [0.0] * len(texts), [False] * len(texts)
        some = [i for i, (_, letters) in enumerate(folded) if letters and self.languages]
        if some:
            bits = self.phrases([folded[i][0] for i in some]) * np.array(self.bits)
            best = bits.argmin(axis=1)
            share = 1 / np.exp2(np.clip(bits.min(axis=1, keepdims=True) - bits, -60, 0)).sum(axis=1)
            for i, b, p, least in zip(some, best.tolist(), share.tolist(), bits.min(axis=1).tolist(), strict=True):
                known[i] = self.fits(b, *folded[i], least)
                languages[i], scores[i] = self.languages[b], p if known[i] else p * MISFIT
        return languages, scores, known


def with_language(docs: DataFrame, samples: tuple[Samples, Samples], text_col: str = "text", keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """``keep`` columns (all by default) with ``<prefix>lang_pred``, ``<prefix>score`` and ``<prefix>known``."""
    keep = docs.columns if keep is None else keep
    shared, key = docs.sparkSession.sparkContext.broadcast(samples), new_key()
    added = [T.StructField(f"{prefix}lang_pred", T.StringType()), T.StructField(f"{prefix}score", T.DoubleType()), T.StructField(f"{prefix}known", T.BooleanType())]
    schema = T.StructType([*(docs.schema[c] for c in keep), *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = built_once("langid", key, lambda: LanguageModel(*shared.value))
        for batch in row_slices(batches):
            languages, scores, known = model.predict(batch.column(batch.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(languages, pa.string()), pa.array(scores, pa.float64()), pa.array(known)], names=schema.names)

    return docs.select(*keep, F.col(text_col).alias("_parsed_text")).mapInArrow(run, schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, known), one row for each input row; learns from rows whose id's crc32 mod 5 is not 0."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    samples = labelled_samples(rows.where(crc_mod("doc_id") != 0))
    found = with_language(rows, samples, keep=["doc_id"])
    return found.select("doc_id", (crc_mod("doc_id") == 0).alias("held_out"), "lang_pred", "score", "known")


def in_known_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text fits the language that is predicted. Learns as ``identify`` does;
    with nothing labelled, rows whose text has a letter stay."""
    labelled = docs.where(crc_mod(id_col) != 0).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    samples = labelled_samples(labelled)
    if not samples[0]:
        return docs.where(F.col(text_col).rlike(r"\p{L}"))
    return with_language(docs, samples, text_col, prefix="_tessera_").where("_tessera_known").select(*docs.columns)
