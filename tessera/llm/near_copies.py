"""Links between near copies whose fingerprints lie further apart than SimHash's byte index can guarantee.

A text with one word in fifty changed keeps a Jaccard similarity of 0.8 over five-word shingles, but its 64-bit
SimHash moves by four to twelve bits, and fingerprints that far apart need share no byte. The same index is
therefore laid over a longer sketch: 64 positional bytes, each cut from the least of the shingle hashes under one of
64 permutations, so that a byte agrees with probability (s + (1 - s) / 256) at similarity s. Postings are kept
under 16 choices of four positions; a pair met in one is tallied over all 64 positional bytes, kept
if the tally reaches ``LEAST_TALLY``, and verified by the exact Jaccard similarity of its whole shingle sets.

At similarity 0.8 a pair shares a posting with probability 0.9998 and reaches the tally with 0.99998.
A pair is refused before its sets are fetched where that is certain: by the sizes of the sets, and by a bitmap of 1024
bits that holds for each bit whether an odd number of shingle hashes falls on it. Sets that differ in d shingles have bitmaps
that differ in d bits at most, and at a similarity of s two sets of p and q shingles differ in (1 - s) / (1 + s) * (p + q) at most.

Postings longer than ``long_posting`` (texts that share much boilerplate, large groups of copies) first link their members
to a few of their heads. What is left apart, members outside a posting's largest component, is met with all members of other
components, in tiles of ``TILE`` members, and every pair is verified whose ends are in different components; where
these are many, each member is verified with its likeliest partner first. So each pair that shares a posting and
reaches the tally is verified or already connected, and components are those of all pairs.

Defined results: texts of equal shingle sets, repeated rows among them, are one class (``set_key``); a null text or one
without a word is the class of the empty set, which is near to nothing else; links do not depend on the order of rows;
an empty table gives no links; only the two named columns of ``docs`` are read, so other names cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import compact, row_slices

SHINGLE = 5
SIMILARITY = 0.8
POSITIONS = 64
CHOSEN = 4
#: Agreeing bytes of a verified pair; 0.8 gives 51 with a standard deviation of 3.2.
LEAST_TALLY = 38
#: Members of a crowded posting that one tile meets with those apart.
TILE = 512
#: Heads of a crowded posting, and how many of them a member is verified with.
HEADS, PARTNERS = 16, 3
#: Pairs left for each member of crowded postings that are verified without meeting likeliest partners first.
MANY = 64
#: Shingle sets of each side of a tile that one task verifies at a time.
TILE_SETS = 256
BITS = 1024
SKETCH = [f"s{i}" for i in range(POSITIONS // 8)]
PARITY = [f"b{i}" for i in range(BITS // 64)]
KEYS = [f"k{i}" for i in range(POSITIONS // CHOSEN)]
#: What a pair of classes is judged by before its sets are fetched.
CLASS = ["size", *PARITY, *SKETCH]

_random = np.random.default_rng(42)
_FACTORS = _random.integers(0, 2**63, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _random.integers(0, 2**63, POSITIONS, dtype=np.uint64)
_MIX = _random.integers(0, 2**63, (POSITIONS // CHOSEN, CHOSEN), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Distinct XXH64 of the word shingles of the A-Z-lower-cased text (fewer words: the whole sequence), ascending."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, seed=42)], dtype=np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends[: len(words) - shingle]]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a : b - 1], 42) for a, b in zip(starts, ends[shingle - 1 :], strict=True)], dtype=np.uint64))


def parity(members: np.ndarray) -> np.ndarray:
    """For each of 1024 bits whether an odd number of the hashes falls on it, as 16 longs."""
    odd = (np.bincount((members & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1).astype(np.uint8)
    return np.packbits(odd).view("<i8")


def sketch(members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 64 positional bytes of a shingle set as eight longs, and its 16 posting keys."""
    least = np.full(POSITIONS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(members), 4096):
        block = members[at : at + 4096, None] * _FACTORS + _OFFSETS
        np.minimum(least, block.min(axis=0), out=least)
    keys = (least.reshape(-1, CHOSEN) * _MIX).sum(axis=1, dtype=np.uint64)
    positional = ((least >> np.uint64(24)) & np.uint64(255)).astype(np.uint8)
    return positional.view("<i8"), keys.view(np.int64)


def sketches(docs: DataFrame, fingerprint: Callable[[str | None], int], id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_hash, fp, set_key, size, b0.., s0.., k0..) of each row: its fingerprint, its class of equal shingle sets, their number,
    the bitmap, the sketch and the posting keys."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    names = ["doc_id", "text_hash", "fp", "set_key", *CLASS, *KEYS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches):
            out = np.zeros((batch.num_rows, len(names) - 2), dtype=np.int64)
            for k, text in enumerate(batch.column(2).to_pylist()):
                members = shingle_set(text, shingle)
                set_key = np.array([xxhash.xxh64_intdigest(members.tobytes())], dtype=np.uint64).view(np.int64)
                out[k] = np.concatenate([[fingerprint(text)], set_key, [len(members)], parity(members), *sketch(members)])
            columns = [pa.array(np.ascontiguousarray(out[:, c])) for c in range(out.shape[1])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=names)

    return rows.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def differing_bytes(a: Column, b: Column) -> Column:
    """At how many of the eight byte positions two longs differ: of the seven lower ones all at once, as the sum sets the high bit of
    each byte with a lower bit and carries nothing into the next. A test for each byte makes plans three times as large."""
    x = a.bitwiseXOR(b)
    lower = F.lit(0x007F7F7F7F7F7F7F)
    marked = (x.bitwiseAND(lower) + lower).bitwiseOR(x).bitwiseAND(F.lit(0x0080808080808080))
    return F.bit_count(marked) + (F.shiftrightunsigned(x, 56) != 0).cast("int")


def tally(a: str, b: str) -> Column:
    """At how many of the 64 positional bytes the sketches of two aliased rows agree."""
    return POSITIONS - sum(differing_bytes(F.col(f"{a}.{s}"), F.col(f"{b}.{s}")) for s in SKETCH)


def likely(a: str, b: str, similarity: float) -> Column:
    """Whether two aliased rows of classes reach the tally and are not refused by their sizes or bitmaps."""
    differing = sum(F.bit_count(F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))) for s in PARITY)
    most = F.lit((1 - similarity) / (1 + similarity)) * (F.col(f"{a}.size") + F.col(f"{b}.size")) + 1e-6
    return (F.abs(F.col(f"{a}.size") - F.col(f"{b}.size")) <= most) & (differing <= most) & (tally(a, b) >= LEAST_TALLY)


def _met(rows: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of rows that share a posting and are likely near, the smaller class first."""
    pair = rows.alias("x").join(rows.alias("y"), F.col("x.key") == F.col("y.key")).where(F.col("x.set_key") < F.col("y.set_key"))
    return pair.where(likely("x", "y", similarity)).select(F.col("x.set_key").alias("a"), F.col("y.set_key").alias("b")).distinct()


def _shared(index: DataFrame, classes: DataFrame) -> DataFrame:
    """(set_key, key, n, and the columns of ``CLASS``): rows of the index whose posting has n > 1 members."""
    sizes = index.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    return compact(index.join(sizes, "key").join(classes.select("set_key", *CLASS), "set_key"))


def _sets(named: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(set_key, members): the shingle sets of the named classes, in one pass over the texts."""
    wanted = named.join(classes, "set_key").select("set_key", F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    texts = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash"))).select("set_key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches):
            sets = [shingle_set(t, shingle).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["set_key", "members"])

    return compact(texts.mapInArrow(run, "set_key long, members array<long>").dropDuplicates(["set_key"]), 5_000)


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs of classes whose whole shingle sets have at least the Jaccard similarity."""
    left = sets.select(F.col("set_key").alias("a"), F.col("members").alias("p"))
    right = sets.select(F.col("set_key").alias("b"), F.col("members").alias("q"))
    common = F.size(F.array_intersect("p", "q"))
    enough = common >= F.lit(similarity) * (F.size("p") + F.size("q") - common)
    return pairs.join(left, "a").join(right, "b").where(enough).select("a", "b")


def verified_in_tiles(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """As ``verified``, for many pairs among few classes: a set is moved once for each tile of classes, not for each pair."""
    pairs = compact(pairs)
    named = pairs.select(F.explode(F.array("a", "b")).alias("set_key")).distinct()
    sides = named.count() // TILE_SETS + 1
    tile = [F.pmod(F.xxhash64(c), F.lit(sides)).alias(t) for c, t in (("a", "i"), ("b", "j"))]
    placed = pairs.select("a", "b", *tile)
    needed = placed.select(F.col("i").alias("k"), F.col("j").alias("l"), F.explode(F.array("a", "b")).alias("set_key")).distinct().join(sets, "set_key")

    def run(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        # sets as views of one array: no copy of the members in Python
        rows = sets.column("members").combine_chunks()
        rows = rows.chunk(0) if isinstance(rows, pa.ChunkedArray) else rows
        flat, ends = rows.values.to_numpy(), rows.offsets.to_numpy()
        members = {k: flat[ends[n] : ends[n + 1]] for n, k in enumerate(sets.column("set_key").to_pylist())}
        near = []
        for a, b in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist(), strict=True):
            p, q = members[a], members[b]
            common = len(np.intersect1d(p, q, assume_unique=True))
            near.append(common >= similarity * (len(p) + len(q) - common))
        return pairs.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    return placed.groupBy("i", "j").cogroup(needed.groupBy("k", "l")).applyInArrow(run, "a long, b long")


def _star(long: DataFrame, similarity: float) -> DataFrame:
    """(a, b): each member of a crowded posting with those ``PARTNERS`` of its postings' heads that it agrees with most. Heads
    are the ``HEADS`` members of a posting with the least hashes."""
    by_hash = Window.partitionBy("key").orderBy(F.xxhash64("set_key"), "set_key")
    heads = long.withColumn("place", F.row_number().over(by_hash)).where(F.col("place") <= HEADS).drop("place")
    met = long.alias("x").join(heads.alias("y"), F.col("x.key") == F.col("y.key")).where(F.col("x.set_key") != F.col("y.set_key"))
    near = met.where(likely("x", "y", similarity)).select(F.col("x.set_key").alias("set_key"), F.struct(tally("x", "y").alias("t"), F.col("y.set_key").alias("head")).alias("p"))
    best = near.groupBy("set_key").agg(F.slice(F.sort_array(F.collect_set("p"), asc=False), 1, PARTNERS).alias("best"))  # of HEADS for each of its 16 postings
    pair = best.select("set_key", F.explode("best.head").alias("head"))
    return pair.select(F.least("set_key", "head").alias("a"), F.greatest("set_key", "head").alias("b"))


def _crossing(long: DataFrame, edges: DataFrame, similarity: float) -> DataFrame:
    """(a, b, t): members outside the largest component of a crowded posting, each with every member of another
    component there that is likely near; t is their tally."""
    from tessera.llm.simhash import components  # which imports this module

    roots = components(edges).withColumnRenamed("node", "set_key")
    rooted = compact(long.join(roots, "set_key", "left").withColumn("root", F.coalesce("root", "set_key")))
    parts = rooted.groupBy("key", "root").agg(F.count("*").alias("size"))
    main = parts.groupBy("key").agg(F.max_by("root", F.struct("size", "root")).alias("main"), F.count("*").alias("parts")).where("parts > 1").drop("parts")
    mixed = rooted.join(main, "key").withColumn("tiles", (F.col("n") / TILE).cast("int") + 1)
    dealt = mixed.withColumn("tile", F.pmod(F.xxhash64("set_key"), F.col("tiles")).cast("int"))
    outside = mixed.where("root <> main").withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    # a pair of members that are both outside is made once
    once = (F.col("y.root") == F.col("y.main")) | (F.col("x.set_key") < F.col("y.set_key"))
    found = outside.alias("x").join(dealt.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.tile") == F.col("y.tile")))
    near = found.where((F.col("x.root") != F.col("y.root")) & once & likely("x", "y", similarity))
    return near.select(F.col("x.set_key").alias("a"), F.col("y.set_key").alias("b"), tally("x", "y").alias("t"))


def near_links(
    classes: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, long_posting: int = 64
) -> DataFrame:
    """(a, b): links between classes that connect the near copies of ``docs``; ``classes`` has one row for each, with the columns of ``sketches``."""
    shared = _shared(classes.select("set_key", F.explode(F.array(*KEYS)).alias("key")), classes)
    pairs = compact(_met(shared.where(F.col("n") <= long_posting), similarity))
    long = shared.where(F.col("n") > long_posting)
    named = pairs.select(F.explode(F.array("a", "b")).alias("set_key")).unionByName(long.select("set_key")).distinct()
    sets = _sets(named, classes, docs, id_col, text_col, shingle)
    members = long.count()
    if not members:
        return compact(verified(pairs, sets, similarity))
    edges = compact(verified(pairs.unionByName(_star(long, similarity)).distinct(), sets, similarity))
    while True:
        crossing = _crossing(long, edges, similarity)
        likeliest = compact(crossing.groupBy("a").agg(F.max_by("b", F.struct("t", "b")).alias("b"), F.count("*").alias("n")))
        left = likeliest.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        if left <= MANY * members:
            break
        # each member's likeliest partner first: what that joins need not be met
        joined = compact(verified(likeliest.select("a", "b"), sets, similarity))
        if joined.isEmpty():
            break
        edges = edges.unionByName(joined)
    if not left:
        return edges
    return edges.unionByName(compact(verified_in_tiles(crossing.select("a", "b").distinct(), sets, similarity)))
