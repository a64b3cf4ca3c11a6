"""Text scalars as column expressions; a pandas UDF only where Spark has no Unicode normalisation."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: patterns that decide what counts as an entity, in the order they are described
WIKILINK = r"(?<!\[)\[\[([^\]|\n]{1,256})(?:\|[^\]]{0,512})?\]\]"
HASHTAG = r"(?i)(?:^|\s)#([a-z][\w/-]*)\b"
ISO_DATE = r"\b(\d{4}-\d{2}-\d{2})\b"
MARKDOWN_LINK = r"\[[^\]\n]{1,512}\]\(([^)\s]+)\)"
CODE_REF = r"([A-Za-z0-9_./-]+\.(?:ts|tsx|js|py|go|rs|java|sql|md)):(\d+)"

# fixed values: what is masked, in the order of masking, and its placeholder
PII_PATTERNS = (
    (r"(?i)\b[\w.%+-]+@[a-z0-9.-]+\.[a-z]{2,}\b", "[email]"),
    (r"\b(?:bearer|Bearer)\s+[\w.~+/-]{10,}=*", "[token]"),
    (r"\beyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,}\b", "[token]"),
    (r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{2,4}){2,7}\b", "[iban]"),
    (r"\b(?:\d[ -]?){12,18}\d\b", "[card]"),
    (r"\+\d[\d\s-]{6,14}\d", "[phone]"),
    (r"\b(?!\d{4}-\d{2}-\d{2}\b)\d{2,4}[ -]\d{2,4}[ -]\d{2,5}\b", "[phone]"),
    (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "[ip]"),
    (r"(?i)\b(?:[a-f0-9]{1,4}:){2,7}[a-f0-9]{0,4}\b", "[ip]"),
)

# fixed values: junk signs of fetched pages, by name
JUNK_PATTERNS = {
    "cloudflare_attention_required": r"(?i)attention required.*cloudflare",
    "cloudflare_just_a_moment": r"(?i)just a moment\.\.\.[\s\S]{0,500}cdn-cgi/challenge-platform",
    "cloudflare_ray_id": r"(?i)cloudflare ray id:",
    "cloudflare_checking_browser": r"(?i)checking your browser before",
    "cf_browser_verification": r"(?i)cf[-_]browser[-_]verification",
    "enable_javascript_cookies": r"(?i)enable javascript and cookies to continue",
    "access_denied": r"(?im)^[\t\x0B\f \xA0\u1680\u2000-\u200A\u202F\u205F\u3000\uFEFF]*access denied\b",
    "captcha_required": r"(?i)verify you are (a )?human|captcha required|please complete the security check",
    "error_page_title": r"(?i)^(403|404|500|502|503|error \d{3}|page not found|forbidden|access denied|service unavailable|robot check|verify you are human)\s*$",
    "cloudflare_challenge_title": r"(?i)^just a moment\.{0,3}$",
}
# fixed values: signs that are looked for in the title or the body alone
JUNK_SCOPES = {"cloudflare_just_a_moment": "body", "cloudflare_ray_id": "body", "error_page_title": "title", "cloudflare_challenge_title": "title"}
WARN_BYTES, BLOCK_BYTES, MAX_MARKUP, HEAD_CHARS = 50_000, 500_000, 0.85, 2048


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), 0)


def title_tokens(title: Column) -> Column:
    return F.filter(F.split(F.lower(title), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def collapse(text: Column) -> Column:
    """White-space runs as one space, trimmed, lower-cased."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def claim_key(claim: Column) -> Column:
    """md5 of the collapsed claim: equal claims have equal keys whatever their spacing and case."""
    return F.md5(collapse(claim))


def value_hash(value: Column) -> Column:
    return F.substring(F.sha2(collapse(value), 256), 1, 16)


def pair_key(a: Column, b: Column) -> Column:
    """A key of an unordered pair."""
    return F.sha2(F.concat_ws("|", F.array_sort(F.array(a, b))), 256)


def wikilinks(text: Column) -> Column:
    found = F.transform(F.regexp_extract_all(text, F.lit(WIKILINK), 1), lambda t: F.trim(t))
    return F.array_distinct(F.filter(found, lambda t: t != ""))


def hashtags(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(HASHTAG), 1), lambda t: F.lower(t)))


def iso_dates(text: Column) -> Column:
    """Plausible dates of 1900 to 2099."""
    found = F.regexp_extract_all(text, F.lit(ISO_DATE), 1)
    year = lambda d: F.substring(d, 1, 4).cast("int")
    month = lambda d: F.substring(d, 6, 2).cast("int")
    day = lambda d: F.substring(d, 9, 2).cast("int")
    return F.array_distinct(F.filter(found, lambda d: year(d).between(1900, 2099) & month(d).between(1, 12) & day(d).between(1, 31)))


def strip_code(text: Column) -> Column:
    """Fenced blocks and inline code as a space."""
    return F.regexp_replace(F.regexp_replace(text, r"(?s)```.*?(```|\z)", " "), r"`[^`\n]*`", " ")


def markdown_links(text: Column) -> Column:
    """Relative targets without leading ``../``, anchor and ``.md``."""
    found = F.filter(F.regexp_extract_all(strip_code(text), F.lit(MARKDOWN_LINK), 1), lambda t: ~t.contains("://"))
    clean = lambda t: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"^(?:\.\./)+", ""), r"#.*$", ""), r"\.md$", ""))
    return F.array_distinct(F.filter(F.transform(found, clean), lambda t: t != ""))


def code_refs(text: Column) -> Column:
    """(path, line) references."""
    paths, lines = F.regexp_extract_all(text, F.lit(CODE_REF), 1), F.regexp_extract_all(text, F.lit(CODE_REF), 2)
    return F.array_distinct(F.zip_with(paths, lines, lambda p, n: F.struct(p.alias("path"), n.cast("int").alias("line"))))


def csv_tags(tags: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.split(tags, ","), lambda t: F.lower(F.trim(t))), lambda t: t != ""))


def scrub_pii(text: Column) -> Column:
    for pattern, placeholder in PII_PATTERNS:
        text = F.regexp_replace(text, pattern, re.sub(r"([$\\])", r"\\\1", placeholder))
    return text


def redact_url_credentials(text: Column) -> Column:
    return F.regexp_replace(text, r"(?i)\b([a-z][a-z0-9+.-]*://)[^/\s:@]+:[^/\s@]+@", "$1***:***@")


def estimated_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 4)


def trigrams(text: Column) -> Column:
    """Distinct three-character runs of each word, padded by two blanks before and one after."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    grams = F.transform(
        words,
        lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))),
    )
    return F.array_distinct(F.flatten(grams))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of trigram sets; 0 where both are empty."""
    x, y = trigrams(a), trigrams(b)
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / union)


def token_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays taken as sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def prose(text: Column) -> Column:
    """Text without code, tags, images and link targets."""
    text = strip_code(text)
    for pattern, to in ((r"(?i)</?[a-z][^>]{0,512}>", ""), (r"!\[[^\]]{0,512}\]\([^)]{0,512}\)", ""), (r"\[([^\]]{0,512})\]\([^)]{0,512}\)", "$1"), (r"https?://\S+", "")):
        text = F.regexp_replace(text, pattern, to)
    return text


def markup_ratio(text: Column) -> Column:
    """Share of the characters outside code that are markup."""
    total = F.length(F.regexp_replace(strip_code(text), r"\s+", ""))
    kept = F.length(F.regexp_replace(prose(text), r"\s+", ""))
    return F.when(total == 0, 0.0).otherwise(1 - kept / total)


def sanity_flags(text: Column, title: Column | None = None, code: Column | None = None) -> Column:
    """Names of the rules that a page breaks; without a ``title`` the body's first line is taken for it. Markup is weighed in bodies large enough to warn
    of, unless they are ``code``."""
    head = F.substring(text, 1, HEAD_CHARS)
    title = F.coalesce(title if title is not None else F.substring_index(head, "\n", 1), F.lit(""))
    size = F.octet_length(text)
    hit = {"title": lambda p: title.rlike(p), "body": lambda p: head.rlike(p), "both": lambda p: title.rlike(p) | F.coalesce(head.rlike(p), F.lit(False))}
    flags = [F.when(hit[JUNK_SCOPES.get(name, "both")](p), F.lit(name)) for name, p in JUNK_PATTERNS.items()]
    weighed = (size > WARN_BYTES) & (size <= BLOCK_BYTES) & (~code if code is not None else F.lit(True))
    flags += [
        F.when(size > BLOCK_BYTES, F.lit("too_large")).when(size > WARN_BYTES, F.lit("large")),
        F.when(F.length(F.trim(text)) == 0, F.lit("empty")),
        F.when(weighed & (markup_ratio(text) > MAX_MARKUP), F.lit("mostly_markup")),
    ]
    return F.array_compact(F.array(*flags))


def lint_issues(title: Column, text: Column) -> Column:
    issues = [
        F.when(F.coalesce(F.trim(title), F.lit("")) == "", F.lit("missing-title")),
        F.when(text.rlike(r"(?i)^\s*(sure|certainly|of course)[,!]|^\s*here(?:'s| is) (?:the|a|your)\b"), F.lit("llm-preamble")),
        F.when(text.rlike(r"(?s)^\s*```(?:markdown|md)?\s*\n.*\n```\s*$"), F.lit("code-fence-wrap")),
        F.when(text.rlike(r"\b(?:YYYY-MM-DD|20XX-XX-XX)\b"), F.lit("placeholder-date")),
        F.when(text.rlike(r"(?i)\b(?:lorem ipsum|TODO: fill)\b"), F.lit("placeholder-text")),
    ]
    return F.array_compact(F.array(*issues))


@F.pandas_udf(T.StringType())
def slugify(text: pd.Series) -> pd.Series:
    """ASCII slug after compatibility decomposition; letters of other scripts stay where nothing ASCII remains."""

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        plain = unicodedata.normalize("NFKD", t)
        ascii_slug = re.sub(r"[^a-z0-9]+", "-", plain.encode("ascii", "ignore").decode().lower()).strip("-")
        return ascii_slug or re.sub(r"[^\w]+", "-", t.lower()).strip("-_")

    return text.map(one)


@F.pandas_udf(T.StringType())
def alias_norm(text: pd.Series) -> pd.Series:
    """Compatibility-composed, lower-cased, collapsed."""
    return text.map(lambda t: None if t is None else re.sub(r"\s+", " ", unicodedata.normalize("NFKC", t)).strip().lower())


def entity_id(kind: Column, name: Column) -> Column:
    """Deterministic id: kind and at most 60 characters of the name's slug."""
    return F.concat_ws(":", kind, F.substring(F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-|-$", ""), 1, 60))


def capitalised_candidates(text: Column) -> Column:
    """@handles and runs of capitalised words."""
    handles = F.regexp_extract_all(text, F.lit(r"@([A-Za-z0-9_]{2,})"), 1)
    names = F.regexp_extract_all(text, F.lit(r"\b(\p{Lu}[\p{L}'-]+(?: \p{Lu}[\p{L}'-]+){0,3})\b"), 1)
    return F.array_distinct(F.concat(handles, names))


def synopsis(text: Column) -> Column:
    """The first two sentences, Latin or ideographic."""
    return F.trim(F.regexp_extract(text, r"(?s)^(\s*[^.!?。！？]*[.!?。！？]+(?:\s*[^.!?。！？]+[.!?。！？]+)?)", 1))


def contextual_prefix(title: Column, summary: Column) -> Column:
    """Context header for embedding a chunk; null without title and summary."""
    blank = lambda c: F.when(F.trim(c) != "", F.trim(c))
    return F.nullif(F.concat_ws("\n", F.concat(F.lit("Title: "), blank(title)), F.concat(F.lit("Summary: "), blank(summary))), F.lit(""))


def json_string_array(reply: Column) -> Column:
    """The first JSON array in a model's reply, or null."""
    return F.from_json(F.regexp_extract(reply, r"(?s)(\[.*?\])", 1), "array<string>")


def rerank_order(reply: Column, n: Column) -> Column:
    """Valid distinct positions (from 1) of a rerank reply."""
    ints = F.from_json(F.regexp_extract(reply, r"(\[[0-9,\s]*\])", 1), "array<int>")
    return F.array_distinct(F.filter(ints, lambda i: (i >= 1) & (i <= n)))
