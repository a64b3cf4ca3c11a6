"""Mentions of known names in prose: leftmost-longest matches that do not overlap, of names of any length.

Texts and names are cut into atoms: runs of letters, digits and underscores, and single other characters; an atom knows whether white
space stands before it. A name can begin only where its first atom stands, and only the lengths that names with this first
atom have are looked up there, all by equi joins. Matches of a text are cut into chains of overlapping ones, since a chain's first match always stands,
and each chain is walked from left to right.

Defined results: texts are compared in compatibility-composed, lower-cased form with any white space between words; code and
``[[links]]`` hold no mention but neither do they part the words around them; a match that begins in lower case takes its place, yet is no
mention; a null text has none; texts and names may have any length.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: the longest text between the brackets of a link, and what a name needs to be looked for
LINK_SPAN = re.compile(r"(?<!\[)\[\[[^\]\n]{0,769}\]\]")
CODE_SPAN = re.compile(r"```.*?(?:```|\Z)|`[^`\n]*`", re.S)
SHORTEST_NAME, LONGEST_NAME = 4, 200
COMMON_WORDS = (
    "mark", "will", "summer", "april", "june", "apple", "next", "square", "amber", "hope", "grace", "rose", "ray", "art", "max", "sky", "dawn",
    "story", "field", "river", "stone", "frank", "drew", "major", "case",
)
ATOM = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"


@F.pandas_udf(T.StringType())
def scannable(text: pd.Series) -> pd.Series:
    """Compatibility-composed text with code and links blanked, each character by a space."""

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        blank = lambda m: " " * len(m[0])
        return LINK_SPAN.sub(blank, CODE_SPAN.sub(blank, t if t.isascii() else unicodedata.normalize("NFKC", t)))

    return text.map(one)


@F.pandas_udf(T.StringType())
def without_code(text: pd.Series) -> pd.Series:
    """The text with code blanked, each character by a space."""
    return text.map(lambda t: None if t is None else CODE_SPAN.sub(lambda m: " " * len(m[0]), t))


def atoms(text: Column) -> Column:
    """The atoms of a text, each with a space before it where white space stands there."""
    return F.regexp_extract_all(F.regexp_replace(text, r"\s+", " "), F.lit(rf" ?(?:{ATOM})"), 0)


def usable_names(names: DataFrame) -> DataFrame:
    """(phrase, slug): of (phrase, slug), those that are neither short, very long, nor a common word."""
    return names.where(F.char_length("phrase").between(SHORTEST_NAME, LONGEST_NAME) & ~F.col("phrase").isin(*COMMON_WORDS))


def _word(atom: Column) -> Column:
    return atom.rlike(r"[\p{L}\p{N}_]$")


def _key(run: Column) -> Column:
    """Atoms in a row as one string, whatever stands before the first."""
    return F.ltrim(F.lower(F.array_join(run, "\n")))


def name_matches(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(id, at, n, phrase, slug, small): every place of a text (id, text) where a name (phrase, slug) stands between word boundaries, the
    longest one at each place. ``at`` counts atoms from 0, ``n`` is the match's number of atoms, ``small`` whether it begins with a small letter."""
    known = names.select("phrase", "slug", atoms(F.trim("phrase")).alias("parts")).where(F.size("parts") > 0)
    known = known.select("phrase", "slug", F.size("parts").alias("n"), _key(F.slice("parts", 1, 1)).alias("first"), _key(F.col("parts")).alias("key"))
    lengths = known.groupBy("first").agg(F.collect_set("n").alias("lengths"))
    # atoms repeat themselves and shrink on the way, so partitions are counted and not merged by their bytes
    dealt = texts.select("id", "text").repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")
    whole = dealt.select("id", atoms(scannable("text")).alias("atoms"))
    places = whole.select("id", F.posexplode("atoms").alias("at", "atom")).withColumn("first", F.ltrim(F.lower("atom")))
    starts = places.join(lengths, "first").groupBy("id").agg(F.collect_list(F.struct("at", "lengths")).alias("starts"))

    def run(at: Column, n: Column) -> Column:
        part = F.slice("atoms", at + 1, n)
        opening, closing, after = F.get("atoms", at), F.get("atoms", at + n - 1), F.get("atoms", at + n)
        cut = (~_word(opening) & ~opening.startswith(" ") & _word(F.get("atoms", at - 1))) | (~_word(closing) & ~after.startswith(" ") & _word(after))
        return F.struct(at.alias("at"), n.alias("n"), _key(part).alias("key"), opening.rlike(r"^\s?\p{Ll}").alias("small"), F.coalesce(cut, F.lit(False)).alias("cut"))

    runs = F.flatten(F.transform("starts", lambda s: F.transform(F.filter(s["lengths"], lambda n: s["at"] + n <= F.size("atoms")), lambda n: run(s["at"], n))))
    # the sizes of both sides are guessed from short columns of ids: broadcast, the atoms of all texts would pass through the driver
    found = whole.join(starts.hint("merge"), "id").select("id", F.explode(runs).alias("r")).select("id", "r.*").where("NOT cut").join(known.drop("first", "n"), "key")
    return found.groupBy("id", "at").agg(F.max_by(F.struct("n", "phrase", "slug", "small"), "n").alias("m")).select("id", "at", "m.*")


def leftmost_longest(matches: DataFrame) -> DataFrame:
    """The matches (id, at, n and others; one at each place) that stand when a text is read from left to right: one begins where no earlier one reaches."""
    in_text = Window.partitionBy("id").orderBy("at")
    reach = F.max(F.col("at") + F.col("n")).over(in_text.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.coalesce((F.col("at") >= reach).cast("int"), F.lit(1))
    chained = matches.withColumn("_begins", begins).withColumn("_chain", F.sum("_begins").over(in_text))
    fields = F.struct("at", "n", *[c for c in matches.columns if c not in ("id", "at", "n")])
    chains = chained.groupBy("id", "_chain").agg(F.sort_array(F.collect_list(fields)).alias("m"))
    none = F.filter("m", lambda _: F.lit(False))
    start = F.struct(F.lit(0).alias("free"), none.alias("kept"))

    def step(acc: Column, m: Column) -> Column:
        taken = F.struct((m["at"] + m["n"]).alias("free"), F.concat(acc["kept"], F.array(m)).alias("kept"))
        return F.when(m["at"] >= acc["free"], taken).otherwise(acc)

    return chains.select("id", F.explode(F.aggregate("m", start, step, lambda acc: acc["kept"])).alias("m")).select("id", "m.*")


def mentions(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(id, at, phrase, slug) of texts (id, text) and names (phrase, slug): every mention, ``at`` counted in atoms."""
    return leftmost_longest(name_matches(texts, names)).where("NOT small").select("id", "at", "phrase", "slug")


def mention_links(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(src, dst, at): the pages that a page's text (id, text) names, each by its first mention; a page does not mention itself."""
    found = mentions(texts, names).where(F.col("id") != F.col("slug"))
    return found.groupBy(F.col("id").alias("src"), F.col("slug").alias("dst")).agg(F.min("at").alias("at"))
