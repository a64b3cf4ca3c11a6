"""Link types of hand-made pages: verbs, precedence, roles, lists, attendance, and every mention with its own surroundings."""

import pytest

from tessera.operators import linktypes as LT

FAR = " " + "z" * 300 + " "
SYNC = "# Sync\n## Attendees\n- [[people/alice]]\n- [[people/bob|Bob]] (CEO), [[people/zed]]\n## Notes\nWe talked about [[people/carol]]'s proposal."
PARTS = "### Participants\n[[dana]], [[eve]]\n## Notes\n**Attendees:** [[frank]] & [[gina]]\nLater [[hank]] joined the thread."
TASKS = "## Attendees\n- [[people/alice]]\n## Action items\n- [[people/bob]]\n```\n## Attendees\n- [[people/carol]]\n```"
BIO = "She is a venture partner at the fund.\n"
CASES = [
    ("person", "she co-founded the company [[x]] in 2019", {"x": "founded"}),
    ("person", "the fund invested in [[x]] at seed", {"x": "invested_in"}),
    ("person", "serves as a technical advisor to [[x]]", {"x": "advises"}),
    ("person", "a senior engineer at [[x]]", {"x": "works_at"}),
    ("person", "founded [[x]] and works at it daily", {"x": "founded"}),
    ("person", "invested in and advises [[x]]", {"x": "invested_in"}),
    ("person", "had lunch near [[x]]", {"x": "mentions"}),
    ("media", "co-founded and invested in [[x]]", {"x": "mentions"}),
    ("meeting", "she co-founded [[x]]", {"x": "mentions"}),
    ("person", f"she is a venture partner{FAR}see [[companies/acme]]", {"companies/acme": "invested_in"}),
    ("person", f"serves as an advisor across the sector{FAR}[[companies/acme]]", {"companies/acme": "advises"}),
    ("person", f"employee at large{FAR}[[companies/acme]], [[people/bob]]", {"companies/acme": "works_at", "people/bob": "mentions"}),
    ("company", f"venture partner{FAR}[[companies/acme]]", {"companies/acme": "mentions"}),
    ("person", f"venture partner and employee at{FAR}[[companies/acme]]", {"companies/acme": "invested_in"}),
    ("meeting", SYNC, {"people/alice": "attended", "people/bob": "attended", "people/zed": "mentions", "people/carol": "mentions"}),
    ("meeting", PARTS, {"dana": "attended", "eve": "attended", "frank": "attended", "gina": "attended", "hank": "mentions"}),
    ("meeting", "Recap of [[people/alice]]'s talk.\n\n## Attendees\n- [[people/alice]]", {"people/alice": "attended"}),
    ("meeting", "## Attendees\n- [[companies/acme]]\n- [[people/alice]]", {"companies/acme": "mentions", "people/alice": "attended"}),
    ("meeting", TASKS, {"people/alice": "attended", "people/bob": "mentions"}),
    ("meeting", "## Attendees\n#### Guests\n[[a]]\n# Next\n[[b]]", {"a": "attended", "b": "mentions"}),
    ("person", f"{BIO}{FAR}\n## Timeline\n- 2024: visited [[companies/acme]]\n", {"companies/acme": "mentions"}),
    ("person", f"{BIO}{FAR}\n## See also\n- [[companies/acme]]\n", {"companies/acme": "mentions"}),
    ("person", f"{BIO}{FAR}We met [[companies/acme]] and others.\n\n## Timeline\n- [[companies/acme]]\n", {"companies/acme": "invested_in"}),
    ("person", f"{BIO}{FAR}\n## Timeline\n- 2019: co-founded [[companies/acme]]\n", {"companies/acme": "founded"}),
    ("person", f"Ann founded [[Acme Labs]].{FAR}She works at [[Acme]].", {"Acme Labs": "founded", "Acme": "works_at"}),
    ("person", f"[[x]] is near.{FAR}He founded [[x#top|it]].{FAR}He works at [[x]].", {"x": "founded"}),
    (None, "works at [[x]] not `[[code]]`", {"x": "works_at"}),
    ("person", None, {}),
    ("person", "", {}),
    ("person", "[[a]]" + "y " * 150_000 + "founded [[a]]", {"a": "founded"}),
]


@pytest.fixture(scope="module")
def found(spark):
    pages = spark.createDataFrame([(f"p{i}", kind, body) for i, (kind, body, _) in enumerate(CASES)], "slug string, type string, body string")
    out = {}
    for r in LT.typed_links(pages).collect():
        out.setdefault(r.src, {})[r.target] = r.type
    return out


@pytest.mark.parametrize("i", range(len(CASES)))
def test_link_types(found, i):
    assert found.get(f"p{i}", {}) == CASES[i][2]


def test_targets_by_their_pages(spark):
    pages = spark.createDataFrame([("people/ann", "person", f"{BIO}{FAR}[[Acme]] and [[acme]] and [[Nobody]] and [[Ann]]")], "slug string, type string, body string")
    resolved = spark.createDataFrame([("Acme", "companies/acme"), ("acme", "companies/acme"), ("Ann", "people/ann")], "target string, dst string")
    assert [tuple(r) for r in LT.typed_links(pages, resolved).collect()] == [("people/ann", "companies/acme", "invested_in")]
