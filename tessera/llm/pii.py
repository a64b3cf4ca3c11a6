"""Personal data: pattern-and-checksum spans, widened by bootstrapped contextual extraction.

Base spans (emails, addresses of version 4, payment cards, phone numbers) are the seeds. The words around seeds induce
lexical patterns: two words before, or one before and one after. Spans of a looser shape that the base rules
pass over are candidates: written-out emails, card-like numbers that fail the check digit, phone numbers without
``+``. Patterns and instances form a bipartite graph scored in ``ROUNDS`` alternating steps: a pattern's confidence is
the summed score of its instances, each as often as it stands there, over all its occurrences in the corpus, whatever stands there; an instance's score is
one less the product of its patterns' doubts, seeds having 1. Patterns with ``MIN_SUPPORT`` distinct seeds and
``MIN_CONFIDENCE`` discover the candidates they stand at.

Only patterns that stand at both seeds and candidates can discover anything; these alone are counted in the corpus. Workers get
them in blocks of ``BLOCK_PATTERNS``, one scan of the corpus a block, so none is dropped.

Defined results: null text is empty; repeated rows are read each, repeated texts are one instance in the graph; spans are
code points with exclusive ends; added spans overlap no base span; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import checkpointed, row_slices

KINDS = ("email", "ip", "card", "phone")
ROUNDS, MIN_SUPPORT, MIN_CONFIDENCE, BLOCK_PATTERNS = 3, 5, 0.8, 200_000

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a number that fails from its first digit fails from each later one, so only first digits are tried
IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOOSE_PHONE = re.compile(r"(?<![0-9+.-])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{3,4}(?![0-9.-])")
LOOSE_EMAIL = re.compile(r"[A-Za-z0-9._%+-]{1,64}\x20?[(\[]?\x20?\bat\b\x20?[)\]]?\x20?[A-Za-z0-9-]{1,63}\x20?[(\[]?\x20?\bdot\b\x20?[)\]]?\x20?[A-Za-z]{2,24}", re.I)

AFTER = re.compile(r"(?=[\s.,;])[.,;]*\s*(\S+)").match
#: Words of the widest span: 19 digits with blanks between them.
MAX_WORDS = 19

Span = tuple[int, int, str]
SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        host = DOMAIN.match(text, at + 1)
        start = at
        if host:
            while start > free and text[start - 1] in LOCAL:
                start -= 1
        if start < at:
            out.append((start, host.end(), "email"))
            free = host.end()
            at = text.find("@", free)
        else:
            at = text.find("@", at + 1)
    return out


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str | None) -> list[Span]:
    """By start, then by kind in the order of KINDS."""
    text = text or ""
    out = emails(text) if "@" in text else []
    if "." in text:
        out += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(len(g.lstrip("0")) <= 3 and int(g.lstrip("0") or 0) <= 255 for g in m.groups())]
    for m in DIGITS.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        out += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 10 <= len(digits_of(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def loose_spans(text: str | None, base: list[Span]) -> list[Span]:
    """Candidates that overlap no base span and no earlier candidate."""
    text = text or ""
    found = [(m.start(), m.end(), "card") for m in DIGITS.finditer(text) if 14 <= len(digits_of(m[0])) <= 19]
    found += [(m.start(), m.end(), "phone") for m in LOOSE_PHONE.finditer(text)]
    if " dot " in (low := text.lower()) or "dot)" in low or "dot]" in low:
        found += [(m.start(), m.end(), "email") for m in LOOSE_EMAIL.finditer(text)]
    out: list[Span] = []
    taken = sorted((a, b) for a, b, _ in base)
    i, free = 0, 0
    for s in sorted(found, key=lambda s: (s[0], KINDS.index(s[2]))):
        while i < len(taken) and taken[i][1] <= s[0]:
            i += 1
        if s[0] >= free and not (i < len(taken) and taken[i][0] < s[1]):
            out.append(s)
            free = s[1]
    return out


def word_before(text: str, at: int) -> tuple[str, int]:
    """The last word that ends at or before ``at``, and where it starts."""
    while at and text[at - 1].isspace():
        at -= 1
    start = at
    while start and not text[start - 1].isspace():
        start -= 1
    return text[start:at].lower(), start


def contexts(text: str, start: int, end: int) -> list[str]:
    """The patterns at a span: the two words before it, and the words on both sides. None if it is part of a word."""
    if start == 0 or not text[start - 1].isspace():
        return []
    last, at = word_before(text, start)
    first, _ = word_before(text, at)
    out = [f"<< {first} {last}"] if first else []
    after = AFTER(text, end)
    if last and after:
        out.append(f"<> {last} {after[1].lower()}")
    return out


def graph_edges(docs: DataFrame) -> DataFrame:
    """(kind, pattern, instance, seed, times): distinct edges and how often each stands in the corpus. Instances are
    hashes; personal data is not shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches):
            rows: Counter = Counter()
            for text in batch.column(0).to_pylist():
                base = base_spans(text)
                for spans, seed in ((base, True), (loose_spans(text, base), False)):
                    for a, b, kind in spans:
                        instance = xxhash.xxh64_intdigest(text[a:b].lower().encode("utf-8", "surrogatepass")) - (1 << 63)
                        rows.update((kind, c, instance, seed) for c in contexts(text, a, b))
            columns = [*(list(zip(*rows, strict=True)) or [[], [], [], []]), list(rows.values())]
            kinds = (pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["kind", "pattern", "instance", "seed", "times"])

    found = docs.select("text").mapInArrow(run, "kind string, pattern string, instance long, seed boolean, times long")
    return found.groupBy("kind", "pattern", "instance", "seed").agg(F.sum("times").alias("times"))


def occurrences(docs: DataFrame, patterns: list[str]) -> DataFrame:
    """(pattern, total): how often each pattern's words stand in the corpus, whatever stands after or between them; words
    on both sides stand as often as the one is followed by the other with 1 to ``MAX_WORDS`` words between."""
    wanted = docs.sparkSession.sparkContext.broadcast(frozenset(tuple(p.split(" ")) for p in patterns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = {p[1:] for p in wanted.value if p[0] == "<<"}
        around: dict[str, set[str]] = {}
        for side, first, second in wanted.value:
            if side == "<>":
                around.setdefault(first, set()).add(second)
        total: Counter = Counter()
        for batch in row_slices(batches):
            for text in batch.column(0).to_pylist():
                words = (text or "").lower().split()
                total.update("<< " + " ".join(p) for p in filter(pairs.__contains__, zip(words, words[1:])))
                for i, w in enumerate(words):
                    if followers := around.get(w):
                        total.update(f"<> {w} {x}" for x in followers.intersection(words[i + 2 : i + 2 + MAX_WORDS]))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["pattern", "total"])

    return docs.select("text").mapInArrow(run, "pattern string, total long").groupBy("pattern").agg(F.sum("total").alias("total"))


def learned_patterns(docs: DataFrame, rounds: int = ROUNDS, min_support: int = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, block_patterns: int = BLOCK_PATTERNS) -> list[tuple[str, str]]:
    """(kind, pattern) of the patterns that discover candidates."""
    edges = checkpointed(graph_edges(docs))
    support = F.count(F.when(F.col("seed"), 1)).alias("support")
    both = edges.groupBy("kind", "pattern").agg(support, F.count(F.when(~F.col("seed"), 1)).alias("candidates")).where(f"support >= {min_support} AND candidates > 0")
    usable = checkpointed(both.select("kind", "pattern", "support"))
    names = usable.select("pattern").distinct()
    sides = names.count() // block_patterns + 1
    totals = None
    for k in range(sides):
        block = [r["pattern"] for r in names.where(F.pmod(F.xxhash64("pattern"), F.lit(sides)) == k).collect()]
        if block:
            counted = checkpointed(occurrences(docs, block))
            totals = counted if totals is None else totals.unionByName(counted)
    if totals is None:
        return []
    graph = checkpointed(edges.join(usable.drop("support"), ["kind", "pattern"]).join(totals, "pattern"))
    scores = graph.select("instance", F.col("seed").cast("double").alias("score")).groupBy("instance").agg(F.max("score").alias("score"))
    confidence = None
    for _ in range(rounds):
        summed = graph.join(scores, "instance").groupBy("kind", "pattern").agg(F.sum(F.col("score") * F.col("times")).alias("sum"), F.max("total").alias("total"), F.sum("times").alias("n"))
        confidence = checkpointed(summed.select("kind", "pattern", (F.col("sum") / F.greatest("total", "n")).alias("confidence")))
        doubt = F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-12))))
        fresh = graph.join(confidence, ["kind", "pattern"]).groupBy("instance").agg(F.max(F.col("seed").cast("double")).alias("known"), doubt.alias("doubt"))
        scores = checkpointed(fresh.select("instance", F.greatest("known", 1 - F.exp("doubt")).alias("score")))
    sure = confidence.where(F.col("confidence") >= min_confidence)
    return sorted((r["kind"], r["pattern"]) for r in sure.select("kind", "pattern").collect())


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, min_support: int = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(doc_id, base, added): arrays of (kind, start, end), each in order; one row for each input row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(frozenset(learned_patterns(rows, rounds, min_support, min_confidence)))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("base", T.ArrayType(SPAN)), T.StructField("added", T.ArrayType(SPAN))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sure = shared.value
        for batch in row_slices(batches):
            bases, added = [], []
            for text in batch.column(1).to_pylist():
                base = base_spans(text)
                loose = [s for s in loose_spans(text, base) if any((s[2], c) in sure for c in contexts(text, s[0], s[1]))] if sure else []
                bases.append([{"kind": k, "start": a, "end": b} for a, b, k in base])
                added.append([{"kind": k, "start": a, "end": b} for a, b, k in loose])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bases, ARROW_SPANS), pa.array(added, ARROW_SPANS)], names=schema.names)

    return rows.mapInArrow(run, schema)


def joined(spans: Column) -> Column:
    """``kind:start:end`` of the spans by start, then kind as listed, comma-joined."""
    order = lambda s: F.struct(s["start"], F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("place"), s["end"], s["kind"])
    return F.array_join(F.transform(F.array_sort(F.transform(spans, order)), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(spans: DataFrame) -> DataFrame:
    """The contract's columns from ``find_spans``: counts and digest of the base spans, and all spans as text."""
    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    return spans.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "added")).alias("spans"))
