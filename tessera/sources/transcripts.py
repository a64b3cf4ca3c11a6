"""Chat exports and logs as turns (session_id, turn, role, text, at).

Four export shapes: a tree of messages, a flat list of messages, lines of a rollout, lines of a session; and plain chat
logs. Drops everything that is not visible speech of the user or the assistant.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TREE = "conversation_id string, id string, title string, current_node string, create_time double, mapping map<string, struct<parent: string, children: array<string>, message: struct<author: struct<role: string>, create_time: double, recipient: string, content: struct<content_type: string, parts: array<string>>, metadata: struct<is_visually_hidden_from_conversation: boolean>>>>"
FLAT = "uuid string, name string, created_at string, chat_messages array<struct<uuid: string, sender: string, text: string, content: array<struct<type: string, text: string>>, created_at: string>>"
ROLLOUT = "timestamp string, type string, payload struct<type: string, role: string, id: string, session_id: string, timestamp: string, message: string, content: array<struct<type: string, text: string>>>"
SESSION = "type string, uuid string, sessionId string, timestamp string, isSidechain boolean, isMeta boolean, message struct<role: string, id: string, content: string>"


def detected_format(item: Column) -> Column:
    """Which shape a JSON record (as text) has."""
    has = lambda p: F.get_json_object(item, p).isNotNull()
    return (
        F.when(has("$.mapping"), "tree").when(has("$.chat_messages"), "flat").when(has("$.payload"), "rollout").when(has("$.sessionId"), "session")
    )


def joined_text(blocks: Column) -> Column:
    """The text blocks of a message, by blank lines."""
    return F.array_join(F.transform(F.filter(blocks, lambda b: F.trim(b["text"]) != ""), lambda b: F.trim(b["text"])), "\n\n")


def numbered(turns: DataFrame, order: str) -> DataFrame:
    """Visible turns with consecutive numbers from 0 in each session."""
    spoken = turns.where(F.col("role").isin("user", "assistant") & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    return spoken.withColumn("turn", F.row_number().over(Window.partitionBy("session_id").orderBy(order)) - 1).select("session_id", "turn", "role", "text", "at")


def tree_turns(exports: DataFrame) -> DataFrame:
    """Turns of tree exports: from the current node, or the latest childless one, up to the root.

    The walk is a fold over at most as many steps as the tree has nodes, within the row, so cycles end.
    """
    session = F.coalesce("conversation_id", "id")
    entries = F.map_entries("mapping")
    childless = F.filter(entries, lambda e: F.size(F.coalesce(e["value"]["children"], F.array())) == 0)
    last = F.array_max(F.transform(childless, lambda e, i: F.struct(F.coalesce(e["value"]["message"]["create_time"], F.lit(-1.0)).alias("t"), i.alias("i"), e["key"].alias("k"))))
    leaf = F.when(F.map_contains_key("mapping", F.coalesce("current_node", F.lit(""))), F.col("current_node")).otherwise(last["k"])
    start = F.struct(leaf.alias("at"), F.array().cast("array<string>").alias("path"))

    def up(acc: Column, _: Column) -> Column:
        stop = acc["at"].isNull() | F.array_contains(acc["path"], F.coalesce(acc["at"], F.lit("")))
        node = F.try_element_at(F.col("mapping"), acc["at"])
        return F.when(stop, F.struct(F.lit(None).cast("string").alias("at"), acc["path"].alias("path"))).otherwise(F.struct(node["parent"].alias("at"), F.concat(F.array(acc["at"]), acc["path"]).alias("path")))

    path = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size("mapping"), F.lit(1))), start, up)["path"]
    walked = exports.where(session.isNotNull() & F.col("mapping").isNotNull()).select(session.alias("session_id"), "mapping", F.posexplode(path).alias("pos", "node"))
    m = F.try_element_at("mapping", F.col("node"))["message"]
    shown = (F.coalesce(m["recipient"], F.lit("all")) == "all") & ~F.coalesce(m["metadata"]["is_visually_hidden_from_conversation"], F.lit(False))
    text = F.trim(F.array_join(F.filter(m["content"]["parts"], lambda p: F.trim(p) != ""), "\n\n"))
    return numbered(walked.where(shown).select("session_id", "pos", m["author"]["role"].alias("role"), text.alias("text"), F.timestamp_millis((m["create_time"] * 1000).cast("long")).alias("at")), "pos")


def flat_turns(exports: DataFrame) -> DataFrame:
    """Turns of flat exports."""
    rows = exports.where(F.trim("uuid") != "").select(F.col("uuid").alias("session_id"), F.posexplode("chat_messages").alias("pos", "m"))
    role = F.when(F.col("m.sender") == "human", "user").when(F.col("m.sender") == "assistant", "assistant")
    text = F.coalesce(F.nullif(joined_text(F.col("m.content")), F.lit("")), F.trim("m.text"))
    return numbered(rows.select("session_id", "pos", role.alias("role"), text.alias("text"), F.try_to_timestamp("m.created_at").alias("at")), "pos")


def rollout_turns(records: DataFrame, file: str = "file", line: str = "line") -> DataFrame:
    """Turns of rollout lines (with their file and line number): the first header names the session; user events and assistant messages are speech."""
    head = records.where("type = 'session_meta'").groupBy(file).agg(F.min_by(F.coalesce("payload.id", "payload.session_id"), line).alias("session_id"))
    user = (F.col("type") == "event_msg") & (F.col("payload.type") == "user_message")
    reply = (F.col("type") == "response_item") & (F.col("payload.type") == "message") & (F.col("payload.role") == "assistant")
    text = F.when(user, F.trim("payload.message")).otherwise(joined_text(F.col("payload.content")))
    rows = records.where(user | reply).select(file, F.col(line).alias("pos"), F.when(user, "user").otherwise("assistant").alias("role"), text.alias("text"), F.try_to_timestamp("timestamp").alias("at"))
    return numbered(rows.join(head.where("session_id IS NOT NULL"), file), "pos")


def session_turns(records: DataFrame, line: str = "line") -> DataFrame:
    """Turns of session lines: no side chains, no meta lines; consecutive parts of one reply are joined."""
    blocks = F.from_json("message.content", "array<struct<type: string, text: string>>")
    content = F.when(F.col("message.content").startswith("["), joined_text(F.filter(blocks, lambda b: b["type"] == "text"))).otherwise(F.trim("message.content"))
    spoken = records.where(F.col("type").isin("user", "assistant") & ~F.coalesce("isSidechain", F.lit(False)) & ~F.coalesce("isMeta", F.lit(False)))
    rows = spoken.select(F.col("sessionId").alias("session_id"), F.col(line).alias("pos"), F.col("type").alias("role"), content.alias("text"), F.try_to_timestamp("timestamp").alias("at"), F.when(F.col("type") == "assistant", F.col("message.id")).alias("reply")).where("session_id IS NOT NULL AND trim(text) <> ''")
    w = Window.partitionBy("session_id").orderBy("pos")
    starts = rows.withColumn("_new", (F.col("reply").isNull() | ~F.col("reply").eqNullSafe(F.lag("reply").over(w))).cast("int"))
    groups = starts.withColumn("_g", F.sum("_new").over(w)).groupBy("session_id", "_g").agg(F.min("pos").alias("pos"), F.first("role").alias("role"), F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("parts"), F.min("at").alias("at"))
    return numbered(groups.select("session_id", "pos", "role", F.array_join(F.transform("parts", lambda p: p["text"]), "\n\n").alias("text"), "at"), "pos")


# fixed values: line grammars of chat logs, tried in this order: (pattern, speaker, text, date, hour, minute) with group numbers, 0 for none
LINE_GRAMMARS = (
    (r"^\[(\d{1,2}):(\d{2})\]\s*(.{1,41}?):\s*(.*)$", 3, 4, 0, 1, 2),
    (r"^\[?(\d{4}-\d{2}-\d{2})[,\s]+(\d{1,2}):(\d{2})(?::\d{2})?\]?(?:\s*-)?\s*(.{1,41}?):\s*(.*)$", 4, 5, 1, 2, 3),
    (r"^<([^>]+)>\s*(.*)$", 1, 2, 0, 0, 0),
    (r"(?i)^([a-z][\w .'-]{0,40}):\s+(.+)$", 1, 2, 0, 0, 0),
)


def chat_log_messages(logs: DataFrame, day: str = "1970-01-01") -> DataFrame:
    """(id, n, speaker, at, text) of logs (id, text): a line that fits a grammar starts a message, others continue the one before."""
    lines = logs.select("id", F.posexplode(F.split("text", r"\r?\n")).alias("pos", "line")).withColumn("line", F.rtrim("line")).where("trim(line) <> ''")
    speaker, body, at = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string")
    for pattern, s, t, d, h, m in reversed(LINE_GRAMMARS):
        fits, group = F.col("line").rlike(pattern), lambda i, p=pattern: F.regexp_extract("line", p, i)
        date = group(d) if d else F.lit(day)
        time = F.concat(F.lit("T"), F.lpad(group(h), 2, "0"), F.lit(":"), group(m), F.lit(":00Z")) if h else F.lit("T00:00:00Z")
        valid = (group(h).cast("int") <= 23) & (group(m).cast("int") <= 59) if h else F.lit(True)
        stamp = F.concat(date, F.when(valid, time).otherwise("T00:00:00Z"))
        speaker, body, at = F.when(fits, F.trim(group(s))).otherwise(speaker), F.when(fits, F.trim(group(t))).otherwise(body), F.when(fits, stamp).otherwise(at)
    parsed = lines.withColumns({"speaker": speaker, "body": body, "at": at})
    marked = parsed.withColumn("n", F.sum(F.col("speaker").isNotNull().cast("int")).over(Window.partitionBy("id").orderBy("pos"))).where("n > 0")
    parts = F.sort_array(F.collect_list(F.struct("pos", F.coalesce("body", F.trim("line")).alias("t"))))
    return marked.groupBy("id", "n").agg(F.max("speaker").alias("speaker"), F.max("at").alias("at"), parts.alias("p")).select("id", "n", "speaker", "at", F.array_join(F.filter(F.transform("p", lambda x: x["t"]), lambda t: t != ""), "\n").alias("text"))


def latest_items(items: DataFrame, key: str = "number", updated: str = "updated_at") -> DataFrame:
    """The copy of each item with the latest update; items without a key pass through."""
    w = Window.partitionBy(key).orderBy(F.desc_nulls_last(updated))
    kept = items.where(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return kept.unionByName(items.where(F.col(key).isNull()))


def packed_parts(turns: DataFrame, budget: int, separator: int = 2) -> DataFrame:
    """(session_id, part, turn): turns in parts of at most ``budget`` bytes, in order, with one turn carried over where it is at
    most a quarter of the budget and still fits. Greedy, so a session's turns pass through one task, sorted by Spark and read batch
    by batch; only the size of the open part is kept."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, part, held, used, last = None, 1, 0, 0, None
        for batch in batches:
            out = []
            for own, turn, size in batch[["session_id", "turn", "bytes"]].itertuples(index=False):
                if session is None or own != session[0]:
                    session, part, held, used = (own,), 1, 0, 0
                if held and used + separator + size > budget:
                    part, held, used = part + 1, 0, 0
                    if last[1] * 4 <= budget and last[1] + separator + size <= budget:
                        out.append((own, part, last[0]))
                        held, used = 1, last[1]
                used += (separator if held else 0) + size
                held, last = held + 1, (turn, size)
                out.append((own, part, turn))
            yield pd.DataFrame(out, columns=["session_id", "part", "turn"])

    sized = turns.select("session_id", "turn", F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes")).repartition("session_id").sortWithinPartitions("session_id", "turn")
    return sized.mapInPandas(pack, f"session_id {turns.schema['session_id'].dataType.simpleString()}, part int, turn long")
