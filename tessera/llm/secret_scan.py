"""Secret scans: candidate strings, and a random forest that removes false positives.

Candidates are long runs of key-like characters; most are hashes, identifiers, paths or numbers. Each is
described by its length, its character transitions, the share of it that dictionary words cover, whether it looks like a path or stands
in one, and its neighbouring words. A Spark ML random forest learned from labelled findings decides; its
prediction runs in the JVM, over candidates only.

Labelled findings are a table (before, candidate, after, place, label). ``labelled_findings`` makes the default one from
rules for common kinds of secrets and of look-alikes, with a fixed seed; pass your own to learn from reviewed findings.

Defined results: null or empty text has no candidates; repeated rows are scanned each; candidates are runs without white
space, so one never spans lines; an empty table gives an empty result; ``redacted`` keeps all columns and rows, and
changes only texts with a secret.
"""

from __future__ import annotations

import math
import random
import re
import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import fresh_names, row_slices

MIN_LENGTH = 16
RUN = rf"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=.-]{{{MIN_LENGTH},}}"
CANDIDATE = re.compile(RUN)
MASK = "<secret>"
TREES, DEPTH, SEED = 40, 8, 7

# fixed values: words that name secrets, and words that name look-alikes
SECRET_WORDS = ("token", "secret", "password", "passwd", "pwd", "apikey", "api_key", "api-key", "key", "auth", "authorization", "bearer", "credential", "credentials", "private", "access_key", "client_secret", "signing")
ALIKE_WORDS = ("sha", "sha1", "sha256", "md5", "hash", "checksum", "digest", "commit", "revision", "etag", "uuid", "guid", "id", "integrity", "version", "build", "fingerprint", "example", "test", "placeholder", "file", "path", "url", "image")
# fixed values: words common in identifiers, paths and prose
DICTIONARY = (
    "about access account action active address admin after agent alert allow amount android answer append apple archive array assert asset async author auto "
    "base batch before begin between block board body boot branch build button buffer cache call case change channel char check child class clean click client clone close cloud code color column comment common config connect content control copy core count create current custom "
    "data date debug default delete deploy design detail device dialog directory disable display document domain double down driver edit element email enable encode engine entity entry environment error event example export extra "
    "false field file filter final find first float folder font form format forward frame from function gate general generate global graph group handle hash head header height hello hidden home host html http icon image import index info init inner input insert instance int item java join json key label language last layer layout left length level library light like line link list load local lock log login long look "
    "main make manager map mark match matrix media member memory menu message meta method middle mode model module month mount move name native network new next node note null number object offset open option order other output owner package page panel parent parse part password path pattern phone photo pixel place play plugin point policy port position post power prefix present print private process product profile project property proxy public push query queue quick "
    "random range read record release remote remove render report request reset resource response rest result return right role root route row rule run sample save scale schema scope screen script search second secret section select send server service session set setting shape share shell show side sign simple single site size slot small sort source space spec stage standard start state static status step stop storage store stream string style submit success summary support switch sync system "
    "table tag target task team template temp test text theme thread time title toggle token tool top total track train transfer tree true type under union unit update upload user utils valid value vector version video view visible wait watch web week widget width window with word work wrap write year zone"
).split()
WORDS = frozenset(w for w in DICTIONARY if len(w) >= 3)
FEATURES = (
    "length", "distinct", "entropy", "lower", "upper", "digit", "mark", "hex", "turns", "letter_digit", "case_turns", "run", "vowel_turns",
    "covered", "longest_word", "slashes", "dots", "underscores", "path_like", "place_is_file", "secret_near", "secret_distance", "alike_near", "alike_distance", "assigned", "quoted", "padding",
)
FINDING = T.StructType([T.StructField(n, T.StringType()) for n in ("before", "candidate", "after", "place")] + [T.StructField("label", T.DoubleType())])


def covered_by_words(text: str) -> tuple[float, int]:
    """Share of the characters that dictionary words cover, longest first from the left, and the longest word's length."""
    low, at, covered, longest = text.lower(), 0, 0, 0
    while at < len(low):
        for n in range(min(12, len(low) - at), 2, -1):
            if low[at : at + n] in WORDS:
                covered, longest = covered + n, max(longest, n)
                at += n
                break
        else:
            at += 1
    return covered / max(1, len(low)), longest


def features(before: str, candidate: str, after: str, place: str | None) -> list[float]:
    """What the forest sees of a candidate, in the order of FEATURES."""
    n = len(candidate)
    counts = {c: candidate.count(c) for c in set(candidate)}
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "m" for c in candidate]
    pairs = list(zip(kinds, kinds[1:]))
    low = candidate.lower()
    vowels = [c in "aeiou" for c in low]
    run = best = 1
    for a, b in zip(candidate, candidate[1:]):
        run = run + 1 if a == b else 1
        best = max(best, run)
    share, longest = covered_by_words(candidate)
    nearby = re.findall(r"[a-z0-9_-]+", before.lower())[-5:][::-1]

    def distance(words: tuple[str, ...]) -> float:
        return float(next((i for i, w in enumerate(nearby) if w in words or any(len(x) > 3 and x in w for x in words)), 9))

    secret, alike = distance(SECRET_WORDS), distance(ALIKE_WORDS)
    tail = before.rstrip(" \t\"'`")[-1:]
    return [
        float(n), len(counts) / n, -sum(c / n * math.log2(c / n) for c in counts.values()),
        *(kinds.count(k) / n for k in "ludm"), sum(c in "0123456789abcdef" for c in low) / n,
        sum(a != b for a, b in pairs) / n, sum({a, b} in ({"l", "d"}, {"u", "d"}) for a, b in pairs) / n, sum({a, b} == {"l", "u"} for a, b in pairs) / n,
        float(best), sum(a != b for a, b in zip(vowels, vowels[1:])) / n,
        share, float(longest), float(candidate.count("/")), float(candidate.count(".")), float(candidate.count("_")),
        float(bool(re.search(r"\.[a-z]{1,5}$", low)) or candidate.startswith(("/", "./", "../"))), float(bool(re.search(r"\.[a-z]{1,5}$", (place or "").lower()))),
        float(secret < 9), secret, float(alike < 9), alike, float(tail in {"=", ":"}), float(before[-1:] in {'"', "'", "`"} and after[:1] in {'"', "'", "`"}), float(candidate.endswith("=")),
    ]


def labelled_findings(spark: SparkSession, each: int = 120, seed: int = SEED) -> DataFrame:
    """Findings with label 1 (secret) or 0, made from rules."""
    r = random.Random(seed)
    pick = lambda alphabet, n: "".join(r.choice(alphabet) for _ in range(n))
    hexes, alnum, b64 = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
    syllables = ("er", "in", "th", "on", "re", "an", "es", "ti", "or", "de", "la", "que", "sch", "ung", "ment", "cion", "the", "ed", "ly", "ou")
    fill = lambda: " ".join("".join(r.choices(syllables, k=r.randint(1, 3))) for _ in range(4))
    assign = lambda words: f"{fill()} {r.choice(words)}{r.choice([' = ', '=', ': ', ':', ' '])}{r.choice(['', chr(34), chr(39)])}"
    words = lambda sep, k: sep.join(r.choice(DICTIONARY) for _ in range(k))
    secrets = [
        lambda: (assign(SECRET_WORDS), pick(hexes, r.choice([32, 40, 48, 64]))),
        lambda: (assign(SECRET_WORDS), pick(alnum, r.randint(20, 64))),
        lambda: (assign(SECRET_WORDS), pick(b64, r.choice([28, 40, 43, 64, 86])) + r.choice(["", "=", "=="])),
        lambda: (assign(SECRET_WORDS), r.choice(["sk_live_", "pk_", "xoxb-", "ghp_", "glpat-", "AKIA", "AIza"]) + pick(alnum, r.randint(20, 40))),
        lambda: (fill() + " ", r.choice(["sk_live_", "xoxb-", "ghp_", "glpat-", "AIza"]) + pick(alnum, r.randint(24, 40))),
        lambda: (fill() + " authorization: bearer ", "eyJ" + pick(b64, 17) + "." + pick(b64, 60) + "." + pick(b64, 43)),
        lambda: (assign(SECRET_WORDS), r.choice(["eyJ" + pick(b64, 33) + "." + pick(b64, r.randint(100, 1500)) + "." + pick(b64, r.choice([43, 86, 342])), pick(b64, r.randint(200, 3200))])),
        lambda: (assign(SECRET_WORDS), pick(string.ascii_letters, r.randint(20, 48))),
    ]
    alikes = [
        lambda: (assign(ALIKE_WORDS), pick(hexes, r.choice([32, 40, 64]))),
        lambda: (fill() + " ", pick(hexes, r.choice([32, 40, 64]))),
        lambda: (assign(ALIKE_WORDS), "-".join(pick(hexes, n) for n in (8, 4, 4, 4, 12))),
        lambda: (fill() + " ", "-".join(pick(hexes, n) for n in (8, 4, 4, 4, 12))),
        lambda: (assign(SECRET_WORDS), r.choice(["x" * r.randint(16, 40), "your-" + words("-", 3), "<" + words("_", 3) + ">", "changeme_" + words("_", 2), "0" * 32, "example_" + words("_", 2)])),
        lambda: (assign(SECRET_WORDS), words(r.choice(["_", ".", "-"]), 4)),
        lambda: (fill() + " ", words("/", r.randint(3, 6)) + r.choice([".py", ".txt", ".json", ""])),
        lambda: (fill() + " ", words(r.choice(["_", "-", ".", ""]), r.randint(3, 5))),
        lambda: (fill() + " ", "".join(r.choices(syllables, k=r.randint(6, 10)))),
        lambda: (fill() + " ", pick(string.digits, r.randint(16, 30))),
        lambda: (fill() + " ", r.choice("-=_.") * r.randint(16, 60)),
        lambda: (fill() + " sha256-", pick(b64, 43) + "="),
        lambda: (assign(SECRET_WORDS) if r.random() < 0.3 else fill() + " ", r.choice([str, str.capitalize])(words("", 1)) + "".join(w.capitalize() for w in words(" ", r.randint(3, 5)).split())),
        lambda: (fill() + " ", words(r.choice(["/", "_", "-", "."]), r.randint(30, 200))),
    ]
    rows = []
    for makers, label in ((secrets, 1.0), (alikes, 0.0)):
        for make in makers:
            for _ in range(each):
                before, candidate = make()
                quote = before[-1:] if before[-1:] in "\"'" else " "
                rows.append((before, candidate, quote + fill(), r.choice(["", "src1", "notes.txt", "app/settings.py", "config.yml"]), label))
    return spark.createDataFrame(rows, FINDING)


def learn(findings: DataFrame) -> PipelineModel:
    """A forest on the findings' features; features are made in Spark, trees by Spark ML."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)
            vectors = [features(b or "", c or "", a or "", p) for b, c, a, p in rows]
            yield pa.RecordBatch.from_arrays([batch.column(4), pa.array(vectors, pa.list_(pa.float64()))], names=["label", "x"])

    rows = findings.where(F.length("candidate") > 0).select(*FINDING.names).mapInArrow(run, "label double, x array<double>")
    named = rows.select("label", *[F.col("x")[i].alias(n) for i, n in enumerate(FEATURES)])
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED).fit(assembler.transform(named))
    return PipelineModel([assembler, forest])


def find_candidates(text: str | None) -> list[tuple[int, int]]:
    """Spans of key-like runs of any length without trailing dots, but for those that may be written words: letters alone
    in one case, or with a leading capital alone."""
    out = []
    for m in CANDIDATE.finditer(text or ""):
        run = m[0].rstrip(".")
        equals = run.find("=")
        start = m.start()
        if 0 < equals < len(run) - 2 and run[equals + 1] != "=":  # name=value without spaces
            start, run = start + equals + 1, run[equals + 1 :]
        if len(run) >= MIN_LENGTH and not (run.isalpha() and (run.isupper() or run[1:].islower())):
            out.append((start, start + len(run)))
    return out


def scan(docs: DataFrame, findings: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", place_col: str | None = "source", keep: list[str] | None = None) -> DataFrame:
    """(doc_id, start, length, score, is_secret), one row for each candidate of each row; ``keep`` names columns to carry instead of doc_id."""
    model = learn(labelled_findings(docs.sparkSession) if findings is None else findings)
    place = F.col(place_col).cast("string") if place_col else F.lit(None).cast("string")
    head = [F.col(c) for c in keep] if keep else [F.col(id_col).cast("long").alias("doc_id")]
    # the features have fixed names, and a carried column may not share them
    kept = [f"kept_{i}" for i in range(len(head))]
    rows = docs.select(*[c.alias(k) for c, k in zip(head, kept, strict=True)], F.col(text_col).alias("scanned"), place.alias("place")).where(F.col("scanned").rlike(RUN))
    names = keep or ["doc_id"]
    schema = T.StructType([*(rows.schema[c] for c in kept), T.StructField("start", T.LongType()), T.StructField("span", T.LongType()), T.StructField("x", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches):
            at, starts, lengths, vectors = [], [], [], []
            for i, (text, where) in enumerate(zip(batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist(), strict=True)):
                for a, b in find_candidates(text):
                    at.append(i)
                    starts.append(a)
                    lengths.append(b - a)
                    vectors.append(features(text[max(0, a - 80) : a], text[a:b], text[b : b + 20], where))
            taken = [batch.column(k).take(pa.array(at, pa.int64())) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*taken, pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(vectors, pa.list_(pa.float64()))], names=schema.names)

    found = rows.mapInArrow(run, schema)
    named = found.select(*kept, "start", "span", *[F.col("x")[i].alias(n) for i, n in enumerate(FEATURES)])
    score = vector_to_array("probability")[1]
    return model.transform(named).select(
        *[F.col(k).alias(n) for k, n in zip(kept, names, strict=True)], "start", F.col("span").alias("length"), score.alias("score"), (F.col("prediction") == 1).alias("is_secret")
    )


def redacted(docs: DataFrame, findings: DataFrame | None = None, text_col: str = "text", place_col: str | None = "source", count_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with each secret replaced by MASK; ``count_col``, where there is one, is counted anew for changed texts.

    Only rows whose text has a run as long as a candidate are joined with their secrets, by a digest of the text and its
    place: the pair that decides them. All other rows, nulls among them, pass through without a shuffle.
    """
    mark, spans_col = fresh_names(docs, "tessera_key", "tessera_spans")
    place = F.col(place_col).cast("string") if place_col else F.lit(None).cast("string")
    key = F.struct(F.sha2(F.col(text_col), 256).alias("text"), F.coalesce(place, F.lit("")).alias("place"))
    has_run = F.coalesce(F.col(text_col).rlike(RUN), F.lit(False))
    texts = docs.where(has_run).select(key.alias(mark), F.col(text_col).alias("scanned"), place.alias("place"))
    secrets = scan(texts, findings, text_col="scanned", place_col="place", keep=[mark]).where("is_secret").select(mark, "start", "length").distinct()
    spans = secrets.groupBy(mark).agg(F.sort_array(F.collect_set(F.struct("start", "length"))).alias(spans_col))
    cut = F.aggregate(
        spans_col,
        F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda acc, s: F.struct(
            F.concat(acc["out"], F.substring(F.col(text_col), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(MASK)).alias("out"),
            (s["start"] + s["length"]).alias("at"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(F.col(text_col), (acc["at"] + 1).cast("int"), F.length(text_col))),
    )
    found = docs.where(has_run).withColumn(mark, key).join(spans, mark, "left").withColumn(mark, F.when(F.col(spans_col).isNotNull(), cut))
    columns = []
    for c in docs.columns:
        if c == text_col:
            columns.append(F.coalesce(mark, c).alias(c))
        elif c == count_col and isinstance(docs.schema[c].dataType, T.NumericType):
            columns.append(F.when(F.col(mark).isNotNull(), F.length(mark).cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c))
        else:
            columns.append(F.col(c))
    return docs.where(~has_run).unionByName(found.select(*columns))
