"""Questions to a code graph: who defines, refers to, calls or is called by a name; many names in one plan.

A mention is (kind, name, surface_form, chunk_id); a chunk (chunk_id, document_id, symbol_name, symbol_qualified,
start_line, end_line); a document (document_id, source_path, source_id). Rows with a null name answer no question.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.facts import in_scope

# fixed values: names of calls by what they reach, matched on the last part of a qualified name
SINKS = {
    "db_call": ("query", "execute", "transaction", "insert", "update", "delete", "select", "findOne", "findMany", "save", "commit"),
    "http_call": ("fetch", "axios", "request", "get", "post", "put", "patch", "urlopen"),
    "file_io": ("readFile", "readFileSync", "writeFile", "writeFileSync", "createReadStream", "createWriteStream", "open", "read", "write"),
    "process_exec": ("spawn", "spawnSync", "exec", "execSync", "execFile", "system"),
}
MOST_CANDIDATES = 25


def sink_kind(callee: Column) -> Column:
    """What a call reaches: database, network, file or process; else unknown."""
    last = F.regexp_extract(callee, r"([^:.]*)$", 1)
    out = F.lit("unknown")
    for kind in reversed(SINKS):
        out = F.when(last.isin(*SINKS[kind]), kind).otherwise(out)
    return out


def mentions_of(mentions: DataFrame, chunks: DataFrame, documents: DataFrame, names: DataFrame, kind: str, k: int, scope: list[str] | None = None) -> DataFrame:
    """The first ``k`` mentions of each name (query_id, name) of one kind, by path and line, lines unknown first.

    Names meet mentions in the first join, so chunks and documents are joined for answers alone.
    """
    found = mentions.where(F.col("kind") == kind).join(names, "name")
    placed = found.join(chunks.select("chunk_id", "document_id", "start_line"), "chunk_id").join(in_scope(documents, scope).select("document_id", "source_path"), "document_id")
    order = Window.partitionBy("query_id").orderBy("source_path", F.asc_nulls_first("start_line"), "chunk_id")
    numbered = placed.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    return numbered.select("query_id", "place", "surface_form", "chunk_id", "document_id", "source_path")


def symbols_at(chunks: DataFrame, lines: DataFrame) -> DataFrame:
    """(query_id, name, chunk_id): the innermost symbol around each line (query_id, document_id, line); ties by chunk."""
    inside = lines.join(chunks.where("symbol_qualified IS NOT NULL"), "document_id").where(F.col("line").between(F.col("start_line"), F.col("end_line")))
    nearest = F.min_by(F.struct(F.col("symbol_qualified").alias("name"), "chunk_id"), F.struct(-F.col("start_line"), F.col("end_line"), "chunk_id")).alias("s")
    return inside.groupBy("query_id").agg(nearest).select("query_id", "s.name", "s.chunk_id")


def callees_at(mentions: DataFrame, chunks: DataFrame, lines: DataFrame) -> DataFrame:
    """(query_id, caller, callee, sink): the distinct calls made in the symbol around each line."""
    calls = mentions.where("kind = 'code-callee'").select("chunk_id", F.col("name").alias("callee")).distinct()
    return symbols_at(chunks, lines).join(calls, "chunk_id").select("query_id", F.col("name").alias("caller"), "callee", sink_kind(F.col("callee")).alias("sink")).distinct()


def disambiguated(chunks: DataFrame, names: DataFrame, most: int = MOST_CANDIDATES) -> DataFrame:
    """(query_id, symbol_qualified): at most ``most`` qualified names that a name (query_id, name), bare or qualified, may mean."""
    known = chunks.where("symbol_qualified IS NOT NULL").select("symbol_name", "symbol_qualified").distinct()
    bare = known.select(F.col("symbol_name").alias("name"), "symbol_qualified")
    either = bare.unionByName(known.select(F.col("symbol_qualified").alias("name"), "symbol_qualified"))
    found = names.join(either, "name").select("query_id", "symbol_qualified").distinct()
    order = Window.partitionBy("query_id").orderBy("symbol_qualified")
    return found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def replaced_edges(edges: DataFrame, written: DataFrame, documents: DataFrame) -> DataFrame:
    """Edges after each of ``documents`` (document_id) wrote its edges anew, a document that wrote none included."""
    fresh = written.join(documents, "document_id", "left_semi").select(*edges.columns).distinct()
    return edges.join(documents, "document_id", "left_anti").unionByName(fresh)


def readiness(chunks: DataFrame, mentions: DataFrame, kind: str, enough: int) -> DataFrame:
    """One row: symbols and mentions of a kind, counted up to ``enough``, and whether the graph can answer."""
    capped = lambda df, name: df.limit(enough).agg(F.count("*").alias(name))
    both = capped(chunks.where("symbol_qualified IS NOT NULL"), "symbols").crossJoin(F.broadcast(capped(mentions.where(F.col("kind") == kind), "mentions")))  # one row each
    return both.withColumn("state", F.when(F.col("symbols") == 0, "no_symbols").when(F.col("mentions") == 0, "no_mentions").otherwise("ready"))
