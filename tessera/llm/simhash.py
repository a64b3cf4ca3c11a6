"""SimHash near-dedup through a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most two bits agree in at least six of their eight
positional bytes, and of the four aligned byte pairs at least two agree, so postings are kept under the six choices of two byte pairs (four positional bytes each). A pair met in a posting is
tallied over all eight byte positions, kept if the tally reaches the guaranteed minimum, and verified
by its Hamming distance; it is taken only from the first posting that it shares, so no pair is made twice.

A posting longer than ``long_posting`` holds near copies of one text. Its members are linked without
making their pairs: each fingerprint is listed under itself and its 64 one-bit neighbours; two
fingerprints within two bits share at least one such listing, and a listing holds at most 65
fingerprints, each linked to the smallest. Links and components are the same as with all pairs.

Defined results: null text or text without a word has fingerprint zero and is linked like any other;
equal texts share a fingerprint; a null id keeps its row with the smallest non-null id of its component
(null if there is none); repeated rows are kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ROWS_A_TASK, checkpointed, compact, counted, fresh_names, row_slices
from tessera.llm.near_copies import CLASS, KEYS, differing_bytes, near_links, sketches

#: The choices of two of the four aligned byte pairs.
BYTE_PAIRS = tuple(combinations(range(4), 2))
#: Differing bits of linked fingerprints; the six choices guarantee a shared posting up to this number.
MAX_BITS = 2


def text_fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash of the word shingles (repeats included) of the A-Z-lower-cased text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, seed=42)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words]).tolist()
        starts = [0, *ends[: len(words) - shingle]]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a : b - 1], 42) for a, b in zip(starts, ends[shingle - 1 :], strict=True)]
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        block = np.array(hashes[at : at + 65536], dtype="<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (votes * 2 > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, text_hash, fp): the fingerprint of each row as a signed long."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches):
            fps = [text_fingerprint(t, shingle) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.int64())], names=["doc_id", "text_hash", "fp"])

    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long")


def byte_tally(a: Column, b: Column) -> Column:
    """At how many of the eight byte positions the two longs agree."""
    return 8 - differing_bytes(a, b)


def _pairs_equal(a: Column, b: Column, choice: tuple[int, int]) -> Column:
    mask = sum(0xFFFF << (16 * i) for i in choice)
    return a.bitwiseXOR(b).bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")) == 0


def postings(fps: DataFrame) -> DataFrame:
    """(choice, key, fp): each distinct fingerprint under its six choices of positional bytes."""
    half = lambda i: F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF).cast("long"))
    keys = [F.struct(F.lit(c).alias("choice"), (F.shiftleft(half(i), 16).bitwiseOR(half(j))).alias("key")) for c, (i, j) in enumerate(BYTE_PAIRS)]
    return fps.select("fp", F.explode(F.array(*keys)).alias("p")).select("p.choice", "p.key", "fp")


def links(fps: DataFrame, long_posting: int = 64) -> DataFrame:
    """(a, b): links between distinct fingerprints that give the same components as all pairs within
    ``MAX_BITS`` bits. ``fps`` has distinct ``fp``."""
    index = postings(fps)
    sizes = index.groupBy("choice", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = checkpointed(index.join(sizes, ["choice", "key"]))
    short = shared.where(F.col("n") <= long_posting).drop("n")
    a, b = F.col("a"), F.col("b")
    met, first = F.lit(False), F.lit(False)
    for c, choice in enumerate(BYTE_PAIRS):
        first = first | ((F.col("choice") == c) & ~met)
        met = met | _pairs_equal(a, b, choice)
    enough = byte_tally(a, b) >= 8 - MAX_BITS
    verified = F.bit_count(a.bitwiseXOR(b)) <= MAX_BITS
    # a pair whose first shared posting is a long one comes from the listings below
    pairs = (
        short.withColumnRenamed("fp", "a")
        .join(short.withColumnRenamed("fp", "b"), ["choice", "key"])
        .where((a < b) & enough & verified & first)
        .select("a", "b")
    )
    crowded = shared.where(F.col("n") > long_posting).select("fp").distinct()
    flips = [F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")) for i in range(64)]
    listed = crowded.select("fp", F.explode(F.array("fp", *flips)).alias("z"))
    star = listed.groupBy("z").agg(F.sort_array(F.collect_set("fp")).alias("m")).where(F.size("m") > 1)
    near = star.select(F.col("m")[0].alias("a"), F.explode(F.slice("m", 2, 65)).alias("b"))
    return pairs.unionByName(near).distinct()


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, root): the smallest node of each node's component, by alternating large-star and small-star steps
    (Kiveris et al., 2014). ``edges`` has columns a, b. Each star cuts its lineage with a checkpoint: the plan of both
    would hold the first three times over, and the driver plans anew after every stage. The minima are dealt anew
    before they meet the edges, so that a node with many edges is a plain skewed join; none pass through the driver."""
    now, rows = counted(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct())
    if not rows:
        return now.select(F.col("v").alias("node"), F.col("u").alias("root"))
    tasks = rows // ROWS_A_TASK + 1
    now = now.coalesce(tasks)
    for _ in range(max_rounds):
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(tasks)
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(tasks).hint("rebalance")
        large = checkpointed(both.join(low.hint("merge"), "u").where("v > u").select("v", F.col("m").alias("u")).coalesce(tasks).distinct().coalesce(tasks))
        low = large.groupBy("v").agg(F.min("u").alias("m")).coalesce(tasks).hint("rebalance")
        joined = large.join(low.hint("merge"), "v")
        small = joined.where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(low.select("v", F.col("m").alias("u"))).coalesce(tasks)
        now = compact(small.distinct())
        # settled: every node either has one smaller neighbour, which has none itself, or has none
        ends = now.select(F.col("v").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(now.select(F.col("u").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)").isEmpty():
            return now.select(F.col("v").alias("node"), F.col("u").alias("root"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def grouped(marked: DataFrame, long_posting: int = 64) -> DataFrame:
    """(fp, component_id) of the distinct fingerprints of ``marked`` (doc_id, fp)."""
    fps = marked.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    members = components(links(fps.select("fp"), long_posting))
    rooted = fps.join(members, fps.fp == members.node, "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return rooted.join(ids, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, long_posting: int = 64) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row for each input row."""
    marked = checkpointed(fingerprints(docs, id_col, text_col, shingle))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return marked.join(grouped(marked, long_posting), "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")


def representatives(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, near_shingle: int = 5, similarity: float = 0.8, long_posting: int = 64
) -> DataFrame:
    """One row of ``docs`` for each group, with all its columns: the least id (null last), then the least hash of the text.
    Groups are the components of links between fingerprints and of those between near copies, which ``near_copies`` finds."""
    rows = checkpointed(sketches(docs, partial(text_fingerprint, shingle=shingle), id_col, text_col, near_shingle))
    named = rows.groupBy("doc_id", "text_hash", "set_key").agg(F.count("*").alias("n"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash", "n")).alias("r")
    sketched = rows.groupBy("set_key").agg(*[F.min(c).alias(c) for c in (*CLASS, *KEYS)])
    classes = checkpointed(named.groupBy("set_key").agg(least).select("*", "r.doc_id", "r.text_hash").join(sketched, "set_key"))

    leads = rows.groupBy("fp").agg(F.min("set_key").alias("lead"))
    alike = rows.select("fp", "set_key").distinct().join(leads, "fp").where("set_key <> lead").select(F.col("lead").alias("a"), F.col("set_key").alias("b"))
    near = links(leads.select("fp"), long_posting)
    first, second = leads.select(F.col("fp").alias("a"), F.col("lead").alias("p")), leads.select(F.col("fp").alias("b"), F.col("lead").alias("q"))
    apart = compact(near.join(first, "a").join(second, "b").select(F.col("p").alias("a"), F.col("q").alias("b")))
    copies = near_links(classes, docs, id_col, text_col, near_shingle, similarity, long_posting)
    members = components(alike.unionByName(apart).unionByName(copies))

    rooted = classes.select("set_key", "r").join(members, classes.set_key == members.node, "left").withColumn("root", F.coalesce("root", "set_key"))
    of, text_hash, n = fresh_names(docs, "kept_id", "kept_hash", "kept_n")
    kept = rooted.groupBy("root").agg(F.min("r").alias("r")).select(F.col("r.doc_id").alias(of), F.col("r.text_hash").alias(text_hash), F.col("r.n").alias(n))
    found = docs.join(kept, docs[id_col].cast("long").eqNullSafe(F.col(of)) & (F.xxhash64(docs[text_col]) == F.col(text_hash)))
    once = found.where(F.col(n) == 1).select(*docs.columns)
    repeated = found.where(F.col(n) > 1).dropDuplicates([id_col, text_col]).select(*docs.columns)
    return once.unionByName(repeated)
