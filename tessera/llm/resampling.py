"""Importance resampling towards a target distribution over hashed n-grams (Xie et al., 2023), with a dictionary of distinct features.

Every run of 1 to ``max_n`` words is a feature. Features are counted over the whole corpus as strings; each distinct string is then hashed
once into a bucket, the counts of buckets in the corpus and in the target give each bucket a gain, and the gain is written
beside the string. A document's weight is the mean gain of its features, and a Gumbel number made from its id turns
drawing without replacement into taking the highest scores.

The gains of the ``frequent`` most frequent features (short strings of a bounded number) go to the workers; a
document's other features are joined to the dictionary, where by construction none is frequent. The bound changes no result.

Defined results: null and empty texts have no feature, weight 0 and no rank; texts of any length are read whole; repeated rows are documents of their
own; a null doc_id counts as the empty string in the draw and comes last among ties; ties end at the smaller doc_id, and rows alike in both are
ranked in any order; without target or documents every bucket's counts are 0; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import ROWS_A_TASK, checkpointed, compact, written
from tessera.llm.tokens import text_slices

BUCKETS = 10_000
#: Features whose gains workers hold, and the bytes that one of them has at most.
FREQUENT, FREQUENT_BYTES = 300_000, 64

#: What each byte becomes: letters A-Z in lower case, digits, a-z and bytes of longer characters as they are, others a space.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Number of words of each text, the words of all texts as numbers, and the distinct words."""
    texts = texts.cast(pa.large_binary())
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    data = b"".join(filter(None, texts.to_pylist())).translate(WORD_BYTES)
    bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    plain = pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
    lines = pc.ascii_split_whitespace(plain)
    numbered = lines.flatten().dictionary_encode()
    numbers, distinct = numbered.indices.to_numpy(zero_copy_only=False), numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
    text = np.repeat(np.arange(len(sizes)), pc.list_value_length(lines).to_numpy(zero_copy_only=False))
    if "" in distinct:  # white space at either end of a text leaves an empty word
        kept = numbers != distinct.index("")
        numbers, text = numbers[kept], text[kept]
    return np.bincount(text, minlength=len(sizes)), numbers, distinct


def features_of(texts: pa.Array, max_n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Number of words of each text, and of all features of all texts: the text, the feature as a number, the distinct features."""
    words, numbers, distinct = words_of(texts)
    of_word = np.repeat(np.arange(len(words)), words)
    names, found_in, found = list(distinct), [of_word], [numbers]
    runs, strings = numbers.astype(np.int64), distinct  # runs of n words by their first word
    for n in range(2, max_n + 1):
        same = of_word[: -(n - 1)] == of_word[n - 1 :]
        pairs = runs[: len(same)][same] * len(distinct) + numbers[n - 1 :][same]
        unique, inverse = np.unique(pairs, return_inverse=True)
        strings = [f"{strings[a]} {distinct[b]}" for a, b in zip((unique // max(len(distinct), 1)).tolist(), (unique % max(len(distinct), 1)).tolist(), strict=True)]
        found_in.append(of_word[: -(n - 1)][same])
        found.append(inverse + len(names))
        names += strings
        runs = np.zeros(len(same), dtype=np.int64)
        runs[same] = inverse
    return words, np.concatenate(found_in), np.concatenate(found), names


def feature_counts(docs: DataFrame, max_n: int = 1, text_col: str = "text") -> DataFrame:
    """(feature, n): how often each distinct feature occurs in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 0):
            _, _, found, names = features_of(batch.column(0), max_n)
            n = np.bincount(found, minlength=len(names))
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()).take(pa.array(some)), pa.array(n[some])], names=["feature", "n"])

    return docs.select(F.col(text_col).cast("string")).mapInArrow(run, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def bucket_of(feature: Column, buckets: int) -> Column:
    return F.crc32(feature.cast("binary")) % F.lit(buckets)


def with_gains(dictionary: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``dictionary`` (feature, n) with each feature's gain; ``target`` is of the same form. The table of buckets has at most ``buckets`` rows."""

    def counted(d: DataFrame, name: str) -> DataFrame:
        return d.groupBy(bucket_of(F.col("feature"), buckets).alias("bucket")).agg(F.sum("n").alias(name))

    totals = [d.agg(F.sum("n").alias(name)) for d, name in ((dictionary, "s_all"), (target, "t_all"))]  # one row each
    table = counted(dictionary, "s").join(counted(target, "t"), "bucket", "left").crossJoin(F.broadcast(totals[0])).crossJoin(F.broadcast(totals[1]))
    s, t, s_all, t_all = (F.coalesce(F.col(c), F.lit(0)).cast("double") for c in ("s", "t", "s_all", "t_all"))
    gain = F.floor(1000 * F.log((t + 1) * (s_all + buckets) / ((s + 1) * (t_all + buckets))))
    return dictionary.withColumn("bucket", bucket_of(F.col("feature"), buckets)).join(F.broadcast(table.select("bucket", gain.alias("gain"))), "bucket").select("feature", "n", "gain")


def document_gains(docs: DataFrame, dictionary: DataFrame, max_n: int = 1, frequent: int = FREQUENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, n_words, n_features, gain): one row a document with the sum of its features' gains, written once."""
    short = dictionary.where(F.octet_length("feature") <= FREQUENT_BYTES).orderBy(F.desc("n"), "feature").limit(frequent).select("feature", "gain").toArrow()
    held = docs.sparkSession.sparkContext.broadcast(dict(zip(short["feature"].to_pylist(), short["gain"].to_pylist(), strict=True)))
    schema = "row long, doc_id long, n_words long, n_features long, gain long, feature string, n long"
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        for batch in text_slices(batches, 2):
            words, text, found, names = features_of(batch.column(2), max_n)
            gains = list(map(known.get, names))
            missing = np.array([g is None for g in gains], dtype=bool)
            gain = np.array([g or 0 for g in gains], dtype=np.int64)
            sums = np.bincount(text, weights=gain[found], minlength=len(words)).astype(np.int64)
            figures = [pa.array(x.astype(np.int64)) for x in (words, np.bincount(text, minlength=len(words)), sums)]
            none = [pa.nulls(len(words), pa.string()), pa.nulls(len(words), pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *figures, *none], names=columns)
            if missing.any():
                rest = missing[found]
                pairs, n = np.unique(text[rest] * len(names) + found[rest], return_counts=True)
                rows, feature = pa.array(pairs // len(names)), pa.array(names, pa.string()).take(pa.array(pairs % len(names)))
                empty = pa.nulls(len(pairs), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), empty, empty, empty, empty, feature, pa.array(n)], names=columns)

    read = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    parts = written(read.mapInArrow(run, schema))
    rare = parts.where("feature IS NOT NULL").select("row", "feature", F.col("n").alias("times")).join(dictionary.select("feature", F.col("gain").alias("each")), "feature")
    rest = rare.groupBy("row").agg(F.sum(F.col("times") * F.col("each")).alias("rest"))
    whole = parts.where("feature IS NULL").drop("feature", "n").join(rest, "row", "left")
    return whole.select("row", "doc_id", "n_words", "n_features", (F.col("gain") + F.coalesce("rest", F.lit(0))).alias("gain"))


def ranked(df: DataFrame, order: list[Column], name: str, partitions: int) -> DataFrame:
    """``df`` with each row's place in ``order``, from 1: rows are range-partitioned and sorted, so no task sees them all."""
    run, place, before = f"{name}_run", f"{name}_place", f"{name}_before"
    rows = df.repartitionByRange(partitions, *order).sortWithinPartitions(*order).withColumn(place, F.monotonically_increasing_id())
    rows = checkpointed(rows.withColumn(run, F.shiftright(place, 33)))
    sizes = rows.groupBy(run).agg(F.count("*").alias("size"))  # one row a partition
    earlier = Window.orderBy(run).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(run, F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias(before))
    within = F.col(place) - F.shiftleft(F.col(run), 33)
    return rows.join(F.broadcast(starts), run).withColumn(name, F.col(before) + within + 1).drop(run, place, before)


def resample(
    docs: DataFrame, target: DataFrame, max_n: int = 1, buckets: int = BUCKETS, min_words: int = 20, percent: int = 10, seed: str = "2024", frequent: int = FREQUENT
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank, n_words): every document; ``rank`` where it is drawn.

    Of the documents with ``min_words`` words or more, ``percent`` in a hundred are drawn, by the highest scores.
    """
    dictionary = written(with_gains(written(feature_counts(docs, max_n)), feature_counts(target, max_n), buckets))
    gains = document_gains(docs, dictionary, max_n, frequent)
    weight = F.when(F.col("n_features") > 0, F.expr("(gain - pmod(gain, n_features)) div n_features")).otherwise(F.lit(0)).cast("long")
    drawn_by = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(drawn_by, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = compact(gains.select("row", "doc_id", "n_words", "n_features", weight.alias("weight")).withColumn("score", F.col("weight") + noise))
    able = scored.where(F.col("n_words") >= min_words)
    able_rows = able.count()
    drawn = able_rows * percent // 100
    placed = ranked(able, [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")], "place", able_rows // ROWS_A_TASK + 1).withColumn("rank", F.when(F.col("place") <= drawn, F.col("place")))
    columns = ["doc_id", "n_features", "weight", "score", "rank", "n_words"]
    return placed.select(columns).union(scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long")).select(columns))


#: DuckDB SQL for the rows of ``resample(documents, benchmark)``.
ORACLE = r"""
WITH crc AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END), b::BIGINT)) AS crc_table),
texts AS (SELECT 'd' AS side, doc_id AS id, row_number() OVER () AS row, coalesce(text, '') AS text FROM documents
  UNION ALL SELECT 'b', NULL, NULL, coalesce(text, '') FROM benchmark),
words AS (SELECT side, id, row, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
uses AS (SELECT side, row, unnest(w) AS f FROM words),
totals AS (SELECT f, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM uses GROUP BY f),
hashed AS (SELECT f, s, t, xor(list_reduce(list_transform(range(0, octet_length(encode(f))::BIGINT), lambda i: ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::BIGINT),
  lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 10000 AS bucket FROM totals, crc),
buckets AS (SELECT bucket, sum(s) AS s, sum(t) AS t FROM hashed GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000) / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000))))::BIGINT AS gain FROM buckets),
documents_gains AS (SELECT row, sum(gain)::BIGINT AS g, count(*) AS n FROM uses JOIN hashed USING (f) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY row),
weights AS (SELECT id AS doc_id, row, len(w) AS n_words, coalesce(n, 0) AS n_features, CASE WHEN n > 0 THEN (g - ((g % n) + n) % n) // n ELSE 0 END AS weight
  FROM words LEFT JOIN documents_gains USING (row) WHERE side = 'd'),
scores AS (SELECT *, weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM weights),
places AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER () * 10 // 100 AS drawn FROM scores WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= drawn THEN place END AS rank, n_words FROM scores LEFT JOIN places USING (row)
"""
