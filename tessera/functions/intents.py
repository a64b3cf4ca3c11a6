"""What a search question asks for: its class, how much detail, recency and salience suit it, and whether it seeks a set."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: phrasings of each class of question, matched whatever the case
FULL_CONTEXT = (
    r"\beverything\b", r"\ball\s+(about|info|information|details)\b", r"\bfull\s+(history|context|picture|story|details)\b", r"\bcomprehensive\b", r"\bdeep\s+dive\b",
    r"\bgive\s+me\s+everything\b",
)
TEMPORAL = (
    r"\bwhen\b", r"\blast\s+(met|meeting|call|conversation|chat|talked|spoke|seen|heard|time)\b", r"\brecent(ly)?\b", r"\bhistory\b", r"\btimeline\b", r"\bmeeting\s+notes?\b",
    r"\bwhat('s| is| was)\s+new\b", r"\blatest\b", r"\bupdate(s)?\s+(on|from|about)\b", r"\bhow\s+long\s+(ago|since)\b", r"\b\d{4}[-/]\d{2}\b", r"\blast\s+(week|month|quarter|year)\b",
)
EVENT = (
    r"\bannounce[ds]?(ment)?\b", r"\blaunch(ed|es|ing)?\b", r"\braised?\s+\$?\d", r"\bfund(ing|raise)\b", r"\bIPO\b", r"\bacquisition\b", r"\bmerge[drs]?\b", r"\bnews\b",
    r"\bhappened?\b",
)
ENTITY = (
    r"\bwho\s+is\b", r"\bwhat\s+(is|does|are)\b", r"\btell\s+me\s+about\b", r"\bdescribe\b", r"\bsummar(y|ize)\b", r"\boverview\b", r"\bbackground\b", r"\bprofile\b",
    r"\bwhat\s+do\s+(i|you|we)\s+know\b",
)
CANONICAL = (
    r"\bwho\s+is\b", r"\bcompiled\s+truth\b", r"\bwhat\s+(is|are|does|means?)\b", r"\bdefin(e|ition|ing)\b", r"\bexplain\s+(what|how|why)\b", r"\b(history|origin|background)\s+of\b",
    r"\bconcept\s+of\b", r"\boverview\s+of\b", r"\btell\s+me\s+about\b", r"::|->|\.\w+\(", r"\b(function|class|method|module)\s+\w+", r"\b(graph|traversal|backlinks?|inbound|outbound)\b",
)
STRONG_RECENCY = (r"\btoday\b", r"\bright\s+now\b", r"\bthis\s+morning\b", r"\bjust\s+now\b")
RECENCY_ON = (
    r"\bwhat'?s\s+(going\s+on|happening|new|latest|up)\b", r"\b(latest|recent(ly)?|currently)\b", r"\b(this|last|past)\s+(week|month|few\s+days|couple\s+days)\b",
    r"\bmeeting\s+(prep|with|for|notes?|brief)\b", r"\bbefore\s+(my|the|our)\s+(meeting|call|sync|chat)\b", r"\bprep(are)?\s+(for|me)\b", r"\bcatch(es|ing)?\b[\s\w]{1,15}\bup\b",
    r"\bremind\s+me\s+(what|about|of)\b", r"\b(update|status|progress)\s+(on|with|from)\b",
)
TIME_BOUND = (
    r"\btoday\b", r"\bright\s+now\b", r"\bthis\s+morning\b", r"\bthis\s+week\b", r"\bsince\s+(launch|last|the|\d)", r"\blast\s+\d+\s+(day|days|week|weeks|month|months)\b",
)
SALIENCE_ON = (
    r"\bwhat'?s\s+(going\s+on|happening|been\s+going|been\s+up)\b", r"\bcatch(es|ing)?\b[\s\w]{1,15}\bup\b", r"\bremind\s+me\s+(what|about|of)\b", r"\bprep(are)?\s+(for|me)\b",
    r"\bbefore\s+(my|the|our)\s+(meeting|call|sync|chat)\b", r"\bmeeting\s+(prep|with|for|brief)\b", r"\b(update|status|progress)\s+(on|with|from)\b", r"\bwhat\s+matters\b",
    r"\bwhat'?s\s+important\b",
)
IMAGES = (
    r"\b(show|find|get|pull)\s+(me\s+)?(the\s+)?(photos?|images?|pictures?|pics?|screenshots?)\b", r"\b(photos?|images?|pictures?|pics?|screenshots?)\s+(of|from|at|with|showing|featuring)\b",
    r"\bwhat\s+does\s+[\w\s']{1,40}?\s+look\s+like\b", r"\b(whiteboard|diagram|slide|screenshot|infographic|chart)s?\s+(of|from|about|showing)\b", r"\bdiagram\s+(of|for|showing)\b",
    r"\bvisual(s|ly)?\s+(of|from|about|showing|representation)\b",
)


def any_of(patterns: tuple[str, ...]) -> str:
    """One expression for all of the patterns."""
    return "(?i)" + "|".join(f"(?:{p})" for p in patterns)


def _asks(question: Column, patterns: tuple[str, ...]) -> Column:
    return question.rlike(any_of(patterns))


def taxonomy(question: Column) -> Column:
    """temporal (full context included), event, entity or general, the first that fits; null is general."""
    temporal = _asks(question, FULL_CONTEXT + TEMPORAL)
    return F.when(temporal, "temporal").when(_asks(question, EVENT), "event").when(_asks(question, ENTITY), "entity").otherwise("general")


def suggested_detail(kind: Column) -> Column:
    """Detail that suits a class of question; none for general ones."""
    return F.when(kind == "entity", "low").when(kind.isin("temporal", "event"), "high")


def suggestions(question: Column) -> dict[str, Column]:
    """Named columns: taxonomy, detail, recency, salience and modality."""
    settled = _asks(question, CANONICAL) & ~_asks(question, TIME_BOUND)  # asks what a thing is, at no stated time
    kind = taxonomy(question)
    return {
        "taxonomy": kind,
        "detail": suggested_detail(kind),
        "recency": F.when(settled, "off").when(_asks(question, STRONG_RECENCY), "strong").when(_asks(question, RECENCY_ON), "on").otherwise("off"),
        "salience": F.when(settled, "off").when(_asks(question, SALIENCE_ON), "on").otherwise("off"),
        "modality": F.when(_asks(question, IMAGES), "image").otherwise("text"),
    }
