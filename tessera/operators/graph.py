"""Typed link graphs: walks, neighbours, degrees, experts, anomalies, orphans, code walks, name resolution."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import trigram_similarity, trigrams


def with_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the cluster's shared one, or in local mode a temporary one where none is named. Elsewhere
    a missing ``spark.checkpoint.dir`` is an error: a folder of one machine is lost with it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessera-"))
    return sc.getCheckpointDir()


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of an iteration in the shared folder."""
    with_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def both_ways(edges: DataFrame) -> DataFrame:
    """(node, neighbour, direction) of (src, dst)."""
    out = edges.select(F.col("src").alias("node"), F.col("dst").alias("neighbour"), F.lit("out").alias("direction"))
    return out.unionAll(edges.select(F.col("dst").alias("node"), F.col("src").alias("neighbour"), F.lit("in").alias("direction")))


def neighbours(edges: DataFrame, node: object, direction: str = "both") -> DataFrame:
    found = both_ways(edges).where(F.col("node") == F.lit(node))
    return found if direction == "both" else found.where(F.col("direction") == direction)


def traverse(edges: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """(seed, node, depth): the least number of steps to each node within ``max_depth`` (10 at most), along src to dst.

    Breadth first; only nodes met for the first time go on, so cycles end and each step joins the frontier alone.
    """
    if not 1 <= max_depth <= 10:
        raise ValueError("max_depth is 1 to 10")
    visited = seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("depth"))
    frontier = visited
    steps = reliable_checkpoint(edges.select("src", "dst").distinct())  # read by each step
    for depth in range(1, max_depth + 1):
        met = frontier.join(steps, frontier.node == steps.src).select("seed", F.col("dst").alias("node")).distinct()
        frontier = reliable_checkpoint(met.join(visited, ["seed", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return visited


def connecting(a: DataFrame, b: DataFrame) -> DataFrame:
    """Nodes that two walks share, nearest by the sum of their depths."""
    return a.select("node", F.col("depth").alias("da")).join(b.select("node", F.col("depth").alias("db")), "node").select("node", (F.col("da") + F.col("db")).alias("depth"))


def backlink_counts(edges: DataFrame) -> DataFrame:
    """(node, n): distinct sources of live, non-self, non-mention links."""
    return edges.where("src <> dst AND coalesce(type, '') <> 'mention'").groupBy(F.col("dst").alias("node")).agg(F.countDistinct("src").alias("n"))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree): links at either end."""
    return edges.select(F.col("src").alias("node")).unionAll(edges.select(F.col("dst").alias("node"))).groupBy("node").agg(F.count("*").alias("degree"))


def neighbour_degrees(edges: DataFrame) -> DataFrame:
    """(node, degree): distinct neighbours."""
    return both_ways(edges).groupBy("node").agg(F.countDistinct("neighbour").alias("degree"))


def experts(edges: DataFrame, pages: DataFrame, k: int) -> DataFrame:
    """Pages by distinct-neighbour degree, then newest, then name."""
    return pages.join(neighbour_degrees(edges), "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree"), "updated_at").orderBy(F.desc("degree"), F.desc("updated_at"), "node").limit(k)


def experts_by_topic(hits: DataFrame, now: Column, k: int) -> DataFrame:
    """Pages by their best hit, freshness (e-fold of 180 days, at least 0.1) and salience; values are told apart to six decimals, equal ones go to the lesser node."""
    best = hits.groupBy("node").agg(F.max("score").alias("score"), F.max("updated_at").alias("updated_at"), F.max("salience").alias("salience"))
    age = F.datediff(now, "updated_at")
    value = F.log1p("score") * F.greatest(F.lit(0.1), F.exp(-age / 180.0)) * (0.5 + 0.5 * F.coalesce("salience", F.lit(0.0)))
    return best.select("node", F.round(value, 6).alias("value")).orderBy(F.desc("value"), "node").limit(k)


def degree_anomalies(counts: DataFrame, sigma: float = 2.0) -> DataFrame:
    """Nodes whose degree reaches the population mean plus ``sigma`` standard deviations. The moments are one aggregated row."""
    moments = counts.agg(F.avg("degree").alias("mean"), F.stddev_pop("degree").alias("sd"))
    return counts.crossJoin(F.broadcast(moments)).where("sd > 0").where(F.col("degree") >= F.col("mean") + sigma * F.col("sd")).select("node", "degree", ((F.col("degree") - F.col("mean")) / F.col("sd")).alias("z"))


def stale_salient(pages: DataFrame, now: Column, floor: float = 0.5, days: int = 90) -> DataFrame:
    """Salient pages that were not touched for ``days``."""
    age = F.datediff(now, "updated_at")
    return pages.where((F.col("salience") >= floor) & (age >= days)).select("node", "salience", age.alias("age_days"))


def orphans(pages: DataFrame, edges: DataFrame) -> DataFrame:
    """Pages that nothing links to."""
    return pages.join(edges.select(F.col("dst").alias("node")), "node", "left_anti")


def dangling(links: DataFrame, titles: DataFrame) -> DataFrame:
    """Links (target) whose normalised target is no title."""
    norm = lambda c: F.lower(F.trim(c))
    return links.withColumn("_t", norm(F.col("target"))).join(titles.select(norm(F.col("title")).alias("_t")).distinct(), "_t", "left_anti").drop("_t")


def adjacency(hits: DataFrame, edges: DataFrame, least: int = 1) -> DataFrame:
    """(query_id, id, n): distinct other hits of the query that link to a hit."""
    ids = hits.select("query_id", "id")
    within = edges.join(ids.select("query_id", F.col("id").alias("src")), "src").join(ids.select("query_id", F.col("id").alias("dst")), ["query_id", "dst"])
    return within.where("src <> dst").groupBy("query_id", F.col("dst").alias("id")).agg(F.countDistinct("src").alias("n")).where(F.col("n") >= least)


def code_walk(edges: DataFrame, start: DataFrame, max_depth: int, max_nodes: int = 200) -> DataFrame:
    """(symbol, depth, confidence) reached from ``start`` (symbol) along (caller, callee); confidence falls with depth."""
    walk = traverse(edges.select(F.col("caller").alias("src"), F.col("callee").alias("dst")), start.select(F.col("symbol").alias("node")), max_depth)
    sure = F.greatest(F.lit(0.05), F.least(F.lit(1.0), 1 / (1 + 0.3 * F.col("depth"))))
    nearest = walk.groupBy(F.col("node").alias("symbol")).agg(F.min("depth").alias("depth")).withColumn("confidence", 1.0 * sure)
    return nearest.orderBy("depth", "symbol").limit(max_nodes)


def resolve_calls(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Calls (document_id, callee) matched to the document's symbols (document_id, name, chunk_id): resolved, ambiguous or unresolved."""
    names = symbols.groupBy("document_id", F.col("name").alias("callee")).agg(F.sort_array(F.collect_set("chunk_id")).alias("chunks"))
    state = F.when(F.col("chunks").isNull(), "unresolved").when(F.size("chunks") == 1, "resolved").otherwise("ambiguous")
    return calls.join(names, ["document_id", "callee"], "left").withColumns({"state": state, "chunk_id": F.when(F.size("chunks") == 1, F.col("chunks")[0])})


def symbol_at_line(lines: DataFrame, symbols: DataFrame) -> DataFrame:
    """The smallest symbol (document_id, name, start_line, end_line) around each line (document_id, line)."""
    inside = lines.join(symbols, "document_id").where(F.col("line").between(F.col("start_line"), F.col("end_line")))
    order = Window.partitionBy("document_id", "line").orderBy(F.col("end_line") - F.col("start_line"), "start_line", "name")
    return inside.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def gazetteer(names: DataFrame) -> DataFrame:
    """(phrase, slug) of (name, slug): normalised names of at least three characters that mean one page."""
    norm = names.select(F.lower(F.trim(F.regexp_replace("name", r"\s+", " "))).alias("phrase"), "slug").where("length(phrase) >= 3")
    return norm.groupBy("phrase").agg(F.countDistinct("slug").alias("n"), F.min("slug").alias("slug")).where("n = 1").drop("n")


def alike_by_trigrams(names: DataFrame, tails: DataFrame, least: float) -> DataFrame:
    """(name, tail, sim) of distinct names and tails whose trigram sets have at least the similarity ``least``. In an order by
    rarity such sets share one of their first size - ceil(least * size) + 1 trigrams, so only these are joined."""
    grams = lambda rows, col: rows.select(col, F.size(trigrams(F.col(col))).alias("n"), F.explode(trigrams(F.col(col))).alias("g"))
    of_names, of_tails = grams(names, "name"), grams(tails, "tail")
    rarity = of_tails.groupBy("g").agg(F.count("*").alias("df"))
    rare = lambda rows, col: (
        rows.join(rarity, "g", "left")
        .withColumn("at", F.row_number().over(Window.partitionBy(col).orderBy(F.coalesce("df", F.lit(0)), "g")))
        .where(F.col("at") <= F.col("n") - F.ceil(least * F.col("n") - 1e-9) + 1)
        .select(col, "g")
    )
    met = rare(of_names, "name").join(rare(of_tails, "tail"), "g").select("name", "tail").distinct()
    return met.withColumn("sim", trigram_similarity(F.col("name"), F.col("tail"))).where(F.col("sim") >= least - 1e-9)


def canonical_slugs(names: DataFrame, pages: DataFrame, aliases: DataFrame, accept: float = 0.7, margin: float = 0.1) -> DataFrame:
    """(name, slug, stage): exact slug, alias, unique tail, unique prefix, then a trigram winner of at least ``accept``, by a
    ``margin`` over the next slug. All stages are equi joins; a runner-up below accept - margin is too far to matter."""
    base = names.select("name").distinct()
    stage = lambda rows, at, name: rows.select("name", "slug", F.lit(at).alias("at"), F.lit(name).alias("stage"))
    only = lambda rows: rows.groupBy("name").agg(F.min("slug").alias("slug"), F.countDistinct("slug").alias("n")).where("n = 1").drop("n")
    ends = pages.select(F.element_at(F.split("slug", "/"), -1).alias("tail"), "slug")
    exact = stage(base.join(pages.select(F.col("slug").alias("name"), "slug"), "name"), 1, "exact")
    alias = stage(base.join(only(aliases.select(F.col("alias").alias("name"), "slug")), "name"), 2, "alias")
    tail = stage(base.join(only(ends.withColumnRenamed("tail", "name")), "name"), 3, "tail")
    starts = ends.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("tail"), F.lit(1))), lambda i: F.substring(F.col("tail"), F.lit(1), i))).alias("name"), "slug")
    prefix = stage(only(base.join(starts, "name")), 4, "prefix")
    found = exact.unionByName(alias).unionByName(tail).unionByName(prefix)
    by_tail = ends.groupBy("tail").agg(F.min("slug").alias("slug"), F.countDistinct("slug").alias("n"))
    close = alike_by_trigrams(base.join(found, "name", "left_anti"), by_tail.select("tail"), accept - margin).join(by_tail, "tail")
    best = Window.partitionBy("name").orderBy(F.desc("sim"), "tail")
    ranked = close.withColumns({"_n": F.row_number().over(best), "_next": F.when(F.col("n") > 1, F.col("sim")).otherwise(F.coalesce(F.lead("sim").over(best), F.lit(0.0)))})
    fuzzy = stage(ranked.where((F.col("_n") == 1) & (F.col("sim") >= accept) & (F.col("sim") - F.col("_next") >= margin)), 5, "trigram")
    return found.unionByName(fuzzy).groupBy("name").agg(F.min_by(F.struct("slug", "stage"), "at").alias("r")).select("name", "r.slug", "r.stage")


def longest_prefix(paths: DataFrame, sources: DataFrame) -> DataFrame:
    """Each path with the source of its longest matching prefix (source_id, path_prefix); null where none matches.

    An equi join: a path is cut into its own prefixes of the lengths that sources have.
    """
    lengths = [r[0] for r in sources.select(F.length("path_prefix")).distinct().collect()]  # few: prefix lengths, not sources
    cut = F.filter(F.array(*[F.struct(F.lit(n).alias("n"), F.substring("path", 1, n).alias("path_prefix")) for n in lengths]), lambda s: F.length(s["path_prefix"]) == s["n"]) if lengths else F.array()
    if not lengths:
        return paths.withColumn("source_id", F.lit(None).cast("string"))
    hits = paths.select("path", F.explode(cut).alias("c")).distinct().select("path", "c.n", "c.path_prefix").join(sources, "path_prefix")
    best = hits.groupBy("path").agg(F.max_by("source_id", "n").alias("source_id"))
    return paths.join(best, "path", "left")
