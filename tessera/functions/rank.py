"""Ranking formulas as column expressions. ``now`` is always given, never read from the clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import title_tokens

# fixed values: weights and constants of the ranking formulas
RRF_K = 60
INTENT_WEIGHTS = {"exact": (0.95, 1.2), "factual": (1.0, 1.15), "howto": (1.0, 1.0), "topic": (1.1, 1.0), "personal": (1.1, 0.95)}
SOURCE_KINDS = {"vault": 1.0, "memory": 0.7, "webhook": 0.5, "mailbox": 0.6, "calendar": 0.6, "transcript": 0.65, "code": 0.85, "github": 0.75}
OTHER_SOURCE = 0.8
CURATION = {
    "originals/": 1.5, "writing/": 1.4, "concepts/": 1.3, "people/": 1.2, "companies/": 1.2, "deals/": 1.2, "meetings/": 1.1, "media/articles/": 1.1,
    "media/repos/": 1.1, "daily/": 0.8, "media/x/": 0.7, "chat/": 0.5, "archive/": 0.5, "extracts/": 0.3,
}
EXCLUDED = ("test/", "attachments/", ".raw/")
RECENCY_DECAY = {
    "originals/": (180, 0.7), "writing/": (365, 0.7), "daily/": (14, 0.4), "meetings/": (60, 0.5), "chat/": (7, 0.4), "media/x/": (7, 0.4),
    "media/articles/": (90, 0.6), "people/": (365, 0.8), "companies/": (365, 0.8), "deals/": (180, 0.7),
}
NO_DECAY = "concepts/"
DEFAULT_DECAY = (120, 0.6)
RECENCY_BOOST = {
    "daily/": (14, 1.5), "meetings/": (60, 1.0), "chat/": (7, 1.0), "media/x/": (7, 1.5), "media/articles/": (90, 0.5), "originals/": (180, 0.5), "writing/": (365, 0.4),
    "people/": (365, 0.3), "companies/": (365, 0.3), "deals/": (180, 0.5),
}
DEFAULT_BOOST = (90, 0.5)
STRONG = 1.5
FACT_HALF_LIFE = {"event": 7, "commitment": 90, "preference": 90, "belief": 365, "fact": 365}


def by_prefix(path: Column, table: dict[str, object], default: Column, value=F.lit) -> Column:
    """The value of the longest prefix of ``path`` in ``table``, as one CASE expression."""
    out = default
    for prefix in sorted(table, key=len):
        out = F.when(path.startswith(prefix), value(table[prefix])).otherwise(out)
    return out


def normalized_path(path: Column) -> Column:
    return F.regexp_replace(path, r"^page(-truth)?://", "")


def rrf(rank: Column, weight: Column | float = 1.0) -> Column:
    """One list's share of a reciprocal rank fusion; ranks from 1."""
    w = weight if isinstance(weight, Column) else F.lit(float(weight))
    return 1 / (F.when(w > 0, RRF_K / w).otherwise(F.lit(float(RRF_K))) + rank)


def age_days(at: Column, now: Column) -> Column:
    return F.greatest(F.lit(0.0), (F.unix_micros(now.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / F.lit(86_400_000_000.0))


def decay(age: Column, half_life: Column, floor: Column) -> Column:
    return floor + (1 - floor) * F.pow(F.lit(0.5), age / half_life)


def recency_decay(path: Column, age: Column) -> Column:
    """Multiplier that falls to a floor with age, by the path's prefix."""
    half = by_prefix(path, {k: float(v[0]) for k, v in RECENCY_DECAY.items()}, F.lit(float(DEFAULT_DECAY[0])))
    floor = by_prefix(path, {k: v[1] for k, v in RECENCY_DECAY.items()}, F.lit(DEFAULT_DECAY[1]))
    return F.when(path.startswith(NO_DECAY), 1.0).otherwise(decay(age, half, floor))


def recency_boost(path: Column, age: Column, strong: bool = False) -> Column:
    half = by_prefix(path, {k: float(v[0]) for k, v in RECENCY_BOOST.items()}, F.lit(float(DEFAULT_BOOST[0])))
    coef = by_prefix(path, {k: v[1] for k, v in RECENCY_BOOST.items()}, F.lit(DEFAULT_BOOST[1]))
    return F.when(path.startswith("concepts/"), 1.0).otherwise(1 + (STRONG if strong else 1.0) * coef * half / (half + age))


def source_boost(kind: Column) -> Column:
    out = F.when(kind.isNull(), 1.0).otherwise(OTHER_SOURCE)
    for k, v in SOURCE_KINDS.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def curation(path: Column) -> Column:
    """Weight of a normalised path."""
    return by_prefix(path, CURATION, F.lit(1.0))


def excluded(path: Column) -> Column:
    """Whether a normalised path is never shown."""
    out = F.lit(False)
    for p in EXCLUDED:
        out = out | path.startswith(p)
    return out


def frontmatter_salience(weight: Column, pinned: Column) -> Column:
    base = F.coalesce(F.least(F.greatest(weight, F.lit(0.5)), F.lit(2.0)), F.lit(1.0))
    return F.when(pinned, F.greatest(base, F.lit(1.3))).otherwise(base)


def mattering(salience: Column, strong: bool = False) -> Column:
    return 1 + (0.3 if strong else 0.15) * F.log1p(F.greatest(salience, F.lit(0.0)))


def backlink_boost(n: Column) -> Column:
    return 1 + 0.05 * F.log1p(n)


def salience_score(tagged: Column, degree: Column, takes: Column, mean_weight: Column) -> Column:
    """Page salience from tag, logarithmic degree and takes, clamped to 0..1."""
    raw = (
        F.when(tagged, 0.5).otherwise(0.0)
        + F.least(F.log1p(degree) / F.log(F.lit(21.0)), F.lit(1.0)) * 0.5
        + F.least(0.05 * takes, F.lit(0.15))
        + 0.05 * F.coalesce(mean_weight, F.lit(0.0))
    )
    return F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0))


def fact_confidence(confidence: Column, kind: Column, age: Column, expired: Column) -> Column:
    """Confidence after decay: e-fold by kind, none for unknown kinds, 0 once expired."""
    half = F.lit(None).cast("double")
    for k, v in FACT_HALF_LIFE.items():
        half = F.when(kind == k, float(v)).otherwise(half)
    return F.when(expired, 0.0).when(half.isNull(), confidence).otherwise(confidence * F.exp(-age / half))


def query_intent(query: Column) -> Column:
    """exact, howto, factual, personal or topic, by rules in this order."""
    q = F.trim(query)
    return (
        F.when(q == "", "topic")
        .when(q.startswith('"') & q.endswith('"'), "exact")
        .when(q.rlike(r"(?i)\bhow (?:do|to|can|should)\b"), "howto")
        .when(q.rlike(r"(?i)\b(?:when|what|who|where|which) (?:is|was|did)\b"), "factual")
        .when(q.rlike(r"(?i)\b(when|recent(ly)?|history|timeline|latest)\b|\blast\s+(week|month|quarter|year)\b|\b\d{4}[-/]\d{2}\b"), "personal")
        .otherwise("topic")
    )


def intent_weight(intent: Column, arm: str) -> Column:
    out = F.lit(1.0)
    for name, pair in INTENT_WEIGHTS.items():
        out = F.when(intent == name, pair[0 if arm == "vector" else 1]).otherwise(out)
    return out


# fixed values: phrasings that ask for a set of things, and signs that one named thing is meant
SET_CUES = (
    r"\ball\s+(the\s+)?(companies|people|projects|tools|papers|notes|places|options|ways|reasons|examples)\b",
    r"\b(list|enumerate)\s+(all|every|the)\b",
    r"\bwhat\s+are\s+(all\b|the\s+(different|various|main|possible|available|other|kinds|types|options|approaches|ways)\b)",
    r"\bwhich\s+(ones|of\s+(them|these|those))\b",
    r"\bdifferent\s+(kinds|types|approaches|ways|options)\b",
    r"\bthe\s+landscape\s+of\b",
    r"\bcompare\b[^.?!]*?\s(vs\.?|versus|and|with|against|to)\s+\S",
    r"\bcompare\s+(the\s+)?(two|three|four|both|several|these|those)\b",
    r"\bevery\s+(company|person|project|note|tool)\b",
    r"\bwho\s+all\b",
)
NAMED_THING = (r'"[^"]{2,}"', "“[^”]{2,256}”", r"\b[a-z0-9]+(?:[-_][a-z0-9]+)+\b")
# fixed values: words that say nothing about a title
TITLE_STOPWORDS = ("the", "a", "an", "of", "and", "or", "to", "in", "on", "for", "with", "at", "by", "from", "as", "is", "it", "this", "that", "my", "your")
# fixed values: multipliers
TITLE_BOOST, ALIAS_BOOST, TRUTH_BOOST = 1.25, 1.05, 2.0
EXACT_BOOST = {"entity": 1.25, "event": 1.1}
CHRONICLE_PREFIXES = ("life/events/", "life/diary/")
CHRONICLE_BOOST = {"on": 1.15, "strong": 1.25}


def concept_shaped(query: Column) -> Column:
    """Whether a question of three words or more asks for a set of things and names none."""
    words = F.size(F.filter(F.split(query, r"\s+"), lambda w: w.rlike(r"\w")))
    return (words >= 3) & query.rlike("(?i)" + "|".join(SET_CUES)) & ~query.rlike("(?i)" + "|".join(NAMED_THING))


def title_phrase(query: Column, title: Column) -> Column:
    """Whether the query is the title, or a run of its tokens with two words of content; false for null."""
    words, whole = title_tokens(query), title_tokens(title)
    content = F.size(F.filter(words, lambda w: ~w.isin(*TITLE_STOPWORDS)))
    spaced = lambda ws: F.concat(F.lit(" "), F.array_join(ws, " "), F.lit(" "))
    run = (content >= 2) & spaced(whole).contains(spaced(words))
    return F.coalesce((F.size(words) > 0) & (F.size(whole) > 0) & ((words == whole) | run), F.lit(False))


def exact_match(query: Column, slug: Column, title: Column) -> Column:
    """Whether the query is the slug, its last part, or the title."""
    asked = F.lower(F.trim(query))
    kebab, own = F.regexp_replace(asked, r"\s+", "-"), F.lower(slug)
    hit = (own == asked) | (own == kebab) | F.endswith(own, F.concat(F.lit("/"), kebab)) | (F.lower(F.trim(title)) == asked)
    return (asked != "") & F.coalesce(hit, F.lit(False))


def exact_boost(kind: Column, matched: Column) -> Column:
    """Multiplier of a match, by the class of the question."""
    out = F.lit(1.0)
    for name, factor in EXACT_BOOST.items():
        out = F.when(matched & (kind == name), factor).otherwise(out)
    return out


def chronicle_boost(path: Column, mode: Column) -> Column:
    """Multiplier of events and diary pages where recency is asked for (off, on, strong)."""
    of_life = F.lit(False)
    for prefix in CHRONICLE_PREFIXES:
        of_life = of_life | F.coalesce(F.regexp_replace(path, "^page://", "").startswith(prefix), F.lit(False))
    return F.when(of_life & (mode == "strong"), CHRONICLE_BOOST["strong"]).when(of_life & (mode == "on"), CHRONICLE_BOOST["on"]).otherwise(1.0)


def truth_boost(path: Column, detail: Column) -> Column:
    """Compiled-truth mirrors count double where little detail is wanted."""
    return F.when(path.startswith("page-truth://") & (detail == "low"), TRUTH_BOOST).otherwise(1.0)
