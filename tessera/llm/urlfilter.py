"""URL filters: exact host/path rules, and pattern rules found through their rarest literal token.

A pattern rule is a regular expression with literal tokens that any URL it matches must contain as whole tokens; a rule
without one, or whose expression does not set a token apart on both sides, is refused when it is made. Each rule is indexed once, under the one of its tokens that occurs in the fewest distinct URLs of the
input. A URL is cut into tokens; each token fetches the rules indexed under it, and only those
rules run their expression on that URL. All work is DataFrame expressions and joins.

Defined results: a null url or one without ``://`` has empty host and path and matches nothing
(verdict ``allow``) unless a pattern does; only A-Z is lower-cased; equal urls get equal verdicts; an empty table gives an empty result; columns other
than the two named ones are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower


@dataclass(frozen=True)
class HostRule:
    """A host with its subdomains and a path prefix; ``name`` is host followed by path."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


# what ends before a token, and begins after it, without a letter or digit: a literal, an escaped literal, or a class of these
_BEFORE = re.compile(r"(://|[/=&-]|\\[^A-Za-z0-9]|\[[?&/=.-]+\])$")
_AFTER = re.compile(r"([/=&-]|\\[^A-Za-z0-9]|\[[?&/=.-]+\])(?![*?{])")
_OPTIONAL_LABELS = re.compile(r"\(\[\^/\?#\]\*\\\.\)\?$")


def sets_apart(pattern: str, token: str) -> bool:
    """Whether the expression holds the token between characters that are neither letters nor digits."""
    for m in re.finditer(rf"(?<![a-z0-9\\]){re.escape(token)}(?![a-z0-9*?{{])", pattern):
        before = _OPTIONAL_LABELS.sub("", pattern[: m.start()])
        if _BEFORE.search(before) and _AFTER.match(pattern, m.end()):
            return True
    return False


@dataclass(frozen=True)
class PatternRule:
    """``pattern`` runs on the URL with A-Z lower-cased; every match contains each of ``tokens`` as a token."""

    rule_id: str
    pattern: str
    tokens: tuple[str, ...]
    verdict: str = "block"

    def __post_init__(self) -> None:
        loose = [t for t in self.tokens if not sets_apart(self.pattern, t)]
        if loose or not self.tokens:
            raise ValueError(f"rule {self.rule_id}: {loose or 'no token'} is not a whole token of every match")


HOST_RULES = (
    HostRule("com", "/en/", "block"),
    HostRule("example.com", "/en/7", "allow"),
    HostRule("net", "/de/", "allow"),
    HostRule("example.net", "/de/8", "block"),
    HostRule("org", "/es/", "block"),
)

PATTERN_RULES = (
    PatternRule("spam-farm", r"://([^/?#]*\.)?spam-farm\.", ("spam", "farm")),
    PatternRule("cheap-pills", r"://([^/?#]*\.)?cheap-pills\.", ("cheap", "pills")),
    PatternRule("casino-win", r"://([^/?#]*\.)?casino-win\.", ("casino", "win")),
    PatternRule("free-bets", r"://([^/?#]*\.)?free-bets\.", ("free", "bets")),
    PatternRule("ads-track", r"://([^/?#]*\.)?ads-track\.", ("ads", "track")),
    PatternRule("adult-chat", r"://([^/?#]*\.)?adult-chat\.", ("adult", "chat")),
    PatternRule("php-session", r"[?&]phpsessid=[0-9a-f]+", ("phpsessid",)),
    PatternRule("java-session", r"[?&]jsessionid=[0-9a-f]+", ("jsessionid",)),
    PatternRule("login-redirect", r"/login[/?][^#]*redirect=", ("login",)),
)


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_rule(host: Column, path: Column, rules: tuple[HostRule, ...]) -> Column:
    """Name of the longest rule that fits, else null."""
    chosen = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        chosen = F.when(fits, F.lit(rule.name)).otherwise(chosen)
    return chosen


def url_tokens(url: Column) -> Column:
    """Distinct runs of a-z and 0-9 of the lower-cased URL."""
    return F.array_distinct(F.filter(F.split(ascii_lower(url), "[^a-z0-9]+"), lambda t: t != ""))


def pattern_index(spark: SparkSession, urls: DataFrame, rules: tuple[PatternRule, ...]) -> DataFrame:
    """(token, rule_id, pattern, verdict): each rule under its rarest literal token in ``urls``.

    ``urls`` has distinct ``url``.
    """
    rows = [(r.rule_id, r.pattern, r.verdict, list(r.tokens)) for r in rules]
    book = spark.createDataFrame(rows, "rule_id string, pattern string, verdict string, tokens array<string>")
    literals = book.select(F.explode("tokens").alias("token"), "rule_id", "pattern", "verdict")
    wanted = sorted({t for r in rules for t in r.tokens})
    # only the rules' own tokens are counted, so the counts are as few as the rules
    seen = (
        urls.select(F.explode(F.filter(url_tokens(F.col("url")), lambda t: t.isin(wanted))).alias("token"))
        .groupBy("token")
        .agg(F.count("*").alias("n"))
    )
    counted = literals.join(seen, "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    best = F.min(F.struct("n", "token")).alias("best")
    return counted.groupBy("rule_id", "pattern", "verdict").agg(best).select(
        F.col("best.token").alias("token"), "rule_id", "pattern", "verdict"
    )


def match_patterns(urls: DataFrame, index: DataFrame) -> DataFrame:
    """(url, pattern_rule, pattern_verdict) for the distinct ``urls`` that some rule matches.

    Of several matching rules an allowing one wins, then the first rule_id.
    """
    keyed = urls.select("url", F.explode(url_tokens(F.col("url"))).alias("token"))
    fetched = keyed.join(index, "token")
    hits = fetched.where(F.rlike(ascii_lower(F.col("url")), F.col("pattern")))
    best = F.min(F.struct((F.col("verdict") != "allow").alias("blocks"), "rule_id", "verdict")).alias("best")
    return hits.groupBy("url").agg(best).select(
        "url", F.col("best.rule_id").alias("pattern_rule"), F.col("best.verdict").alias("pattern_verdict")
    )


def filter_urls(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    host_rules: tuple[HostRule, ...] = HOST_RULES,
    pattern_rules: tuple[PatternRule, ...] = PATTERN_RULES,
) -> DataFrame:
    """(page_id, host, path, rule, verdict, pattern_rule), one row for each input row."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    urls = rows.where(F.col("url").isNotNull()).select("url").distinct()
    matched = match_patterns(urls, pattern_index(pages.sparkSession, urls, pattern_rules))
    named = rows.select("page_id", "url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    judged = named.withColumn("rule", host_rule(F.col("host"), F.col("path"), host_rules)).join(matched, "url", "left")
    by_rule = F.lit(None).cast("string")
    for rule in host_rules:
        by_rule = F.when(F.col("rule") == rule.name, F.lit(rule.verdict)).otherwise(by_rule)
    verdict = F.coalesce(by_rule, F.col("pattern_verdict"), F.lit("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "pattern_rule")


def oracle() -> str:
    """The same judgement in DuckDB SQL, every rule tried on every URL."""
    lower = "translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    rule = "CAST(NULL AS VARCHAR)"
    verdicts = ""
    for r in sorted(HOST_RULES, key=lambda r: (len(r.name), r.name)):
        rule = f"CASE WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.name}' ELSE {rule} END"
        verdicts += f" WHEN rule = '{r.name}' THEN '{r.verdict}'"
    pattern = "CASE " + " ".join(f"WHEN regexp_matches({lower}, '{r.pattern}') THEN '{r.rule_id}'" for r in sorted(PATTERN_RULES, key=lambda r: r.rule_id)) + " END"
    return f"""
    WITH parts AS (
        SELECT page_id, url,
               coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
               coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
        FROM pages),
    ruled AS (SELECT page_id, host, path, {rule} AS rule, {pattern} AS pattern_rule FROM parts)
    SELECT page_id, host, path, rule,
           CASE {verdicts} WHEN pattern_rule IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, pattern_rule
    FROM ruled"""
