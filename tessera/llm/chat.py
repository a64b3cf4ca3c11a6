"""Chat formatting: collapse cumulative snapshots of a conversation, then render what is left.

Logging systems often store a conversation after each turn, so that one log holds every prefix of the
final exchange under different ids. Each turn gets a 128-bit digest of its position, role and text; the
running XOR of the digests identifies each prefix. A conversation whose whole digest is also a
proper prefix of a longer one, or equals that of a conversation with a smaller id, is dropped by an anti-join.

Defined results: rows without conv_id belong to no conversation and give no output; null role or text
are rendered as empty strings; repeated rows count once; turns are ordered by (turn, role, text), so ties
have one order; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TURN_OPEN, TURN_CLOSE = "<|", "<|end|>\n"


def assembled(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): the ordered turns of each conversation as one array."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turn = F.struct("turn", "role", "text")
    return (
        rows.where(F.col("conv_id").isNotNull())
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_set(turn)).alias("turns"))
    )


def prefix_digests(convs: DataFrame) -> DataFrame:
    """(conv_id, n_turns, k, h1, h2): the digest of the first k turns, for each k of each conversation."""
    digests = convs.select(
        "conv_id",
        F.size("turns").alias("n_turns"),
        F.posexplode(
            F.transform(
                "turns",
                lambda t, i: F.struct(
                    F.xxhash64(i, t["role"], t["text"]).alias("h1"), F.xxhash64(t["text"], t["role"], i, F.lit("second")).alias("h2")
                ),
            )
        ).alias("pos", "h"),
    )
    so_far = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return digests.select(
        "conv_id", "n_turns", (F.col("pos") + 1).alias("k"),
        F.bit_xor("h.h1").over(so_far).alias("h1"), F.bit_xor("h.h2").over(so_far).alias("h2"),
    )


def maximal(convs: DataFrame) -> DataFrame:
    """(conv_id, n_copies): conversations that no longer one continues, one for each distinct content."""
    digests = prefix_digests(convs)
    whole = (
        digests.where("k = n_turns")
        .groupBy("k", "h1", "h2")
        .agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    )
    proper = digests.where("k < n_turns").select("k", "h1", "h2").distinct()
    return whole.join(proper, ["k", "h1", "h2"], "left_anti").select("conv_id", "n_copies")


def format_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies, text) of the maximal conversations."""
    convs = assembled(conversations)
    rendered = F.array_join(
        F.transform("turns", lambda t: F.concat(F.lit(TURN_OPEN), t["role"], F.lit("|>\n"), t["text"], F.lit(TURN_CLOSE))), ""
    )
    return convs.join(maximal(convs), "conv_id").select(
        "conv_id", F.size("turns").alias("n_turns"), "n_copies", rendered.alias("text")
    )


ORACLE = """
WITH turns AS (
    SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
    SELECT conv_id, count(*) AS n,
           list(role || chr(31) || text ORDER BY turn NULLS FIRST, role, text) AS content,
           string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS rendered
    FROM turns GROUP BY conv_id),
distinct_convs AS (SELECT min(conv_id) AS conv_id, n, content, min(rendered) AS rendered, count(*) AS n_copies FROM convs GROUP BY n, content)
SELECT a.conv_id, CAST(a.n AS INTEGER) AS n_turns, a.n_copies, a.rendered AS text
FROM distinct_convs a
WHERE NOT EXISTS (
    SELECT 1 FROM distinct_convs b WHERE b.n > a.n AND b.content[1] = a.content[1] AND list_slice(b.content, 1, a.n) = a.content)
"""
