"""Cover density against all windows of a text, ranking on planted relevance, and mentions against one alternation of all names."""

import itertools
import math
import random

import pytest
import regex
from pyspark.sql import functions as F

from tessera.operators import fulltext as FT
from tessera.operators import mentions as M


def plain_cover_density(words, terms):
    """``words`` are (word, weight). All windows that hold every term and within which no smaller one does."""
    hits = [(p, w, x) for p, (w, x) in enumerate(words) if w in terms]
    whole = [(i, j) for i, j in itertools.combinations_with_replacement(range(len(hits)), 2) if {w for _, w, _ in hits[i : j + 1]} == terms]
    least = [(i, j) for i, j in whole if not any((a, b) != (i, j) and i <= a and b <= j for a, b in whole)]
    score = 0.0
    for i, j in least:
        n = j - i + 1
        score += n / sum(1 / x for _, _, x in hits[i : j + 1]) / (1 + hits[j][0] - hits[i][0] - (j - i))
    return score


def test_cover_density_equals_all_windows(spark):
    r = random.Random(7)
    docs = [(i, " ".join(r.choices("abcdef", k=r.randint(0, 4))), " ".join(r.choices("abcdefg,", k=r.randint(0, 40)))) for i in range(60)] + [(60, None, "a b"), (61, "", None)]
    queries = [(1, "a b"), (2, "c"), (3, "D e! f a"), (4, "a a b"), (5, "zz a"), (6, " ?"), (7, "g b c d")]
    index = FT.positional_index(spark.createDataFrame(docs, "doc_id int, head string, text string"), "doc_id", {"A": F.col("head"), "B": F.col("text")})
    got = {(h.query_id, h.id): h.score for h in FT.cover_density_hits(index, FT.numbered_terms(spark.createDataFrame(queries, "query_id int, query string"))).collect()}
    want = {}
    for q, query in queries:
        terms = set(regex.findall(r"[\p{L}\p{N}]+", query.lower()))
        for i, head, text in docs:
            words = [(w, x) for t, x in ((head, 1.0), (text, 0.4)) for w in regex.findall(r"[\p{L}\p{N}]+", (t or "").lower())]
            if terms and terms <= {w for w, _ in words}:
                want[q, i] = plain_cover_density(words, terms)
    assert set(got) == set(want) and len(got) > 50
    assert all(math.isclose(got[k], want[k], abs_tol=1e-8) for k in want)


def test_cover_density_by_hand(spark):
    docs = spark.createDataFrame([(1, "x y"), (2, "x far y"), (3, "x y x")], "id int, text string")
    terms = FT.numbered_terms(spark.createDataFrame([(1, "y x")], "query_id int, query string"))
    got = FT.keyword_arm(FT.positional_index(docs, "id", {"B": F.col("text")}), terms, 5)
    assert [(h.id, round(h.score, 6)) for h in got.orderBy("rank").collect()] == [(3, 0.8), (1, 0.4), (2, 0.2)]
    named = FT.keyword_arm(FT.positional_index(docs, "id", {"A": F.when(F.col("id") == 2, "x y"), "B": F.col("text")}), terms, 1)
    assert [h.id for h in named.collect()] == [2]
    factors = spark.createDataFrame([(2, 9.0)], "id int, factor double")
    pages = spark.createDataFrame([(1, "p"), (2, "q"), (3, "p")], "id int, document_id string")
    pooled = FT.keyword_arm(FT.positional_index(docs, "id", {"B": F.col("text")}), terms, 5, factors, pages)
    assert [(h.id, round(h.score, 6)) for h in pooled.orderBy("rank").collect()] == [(2, 1.8), (3, 0.8)]


def test_floors_on_planted_relevance(spark):
    """Thirty topics; each has one passage that names it closely and nine that spread its words; the close one has to lead."""
    r = random.Random(11)
    topics = [[f"t{i}{x}" for x in "abc"] for i in range(30)]
    noise = [f"w{i}" for i in range(200)]
    docs, relevant = [], {}
    for i, topic in enumerate(topics):
        near = r.choices(noise, k=60)
        near[30:30] = topic
        docs.append((i * 10, " ".join(near)))
        relevant[i] = i * 10
        for k in range(1, 10):
            far = r.choices(noise, k=60)
            for at, w in zip((5, 30, 55), topic, strict=True):
                far[at] = w
            docs.append((i * 10 + k, " ".join(far)))
    terms = FT.numbered_terms(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(topics)], "query_id int, query string"))
    hits = FT.keyword_arm(FT.positional_index(spark.createDataFrame(docs, "id int, text string"), "id", {"B": F.col("text")}), terms, 10).collect()
    ranks = {h.query_id: h.rank for h in hits if h.id == relevant[h.query_id]}
    assert len(ranks) == 30 and sum(1 / x for x in ranks.values()) / 30 == 1.0


def plain_mentions(text, names):
    if text is None:
        return []
    masked = M.LINK_SPAN.sub(lambda m: " " * len(m[0]), M.CODE_SPAN.sub(lambda m: " " * len(m[0]), text))
    ordered = sorted(names, key=lambda x: (-len(x[0]), x[0]))
    slug = dict(names)
    pattern = regex.compile(r"(?<![\p{L}\p{N}_])(?:" + "|".join(r"\s+".join(map(regex.escape, p.split(" "))) for p, _ in ordered) + r")(?![\p{L}\p{N}_])", regex.I)
    out = []
    for m in pattern.finditer(masked):
        if not regex.match(r"\p{Ll}", m[0]):
            phrase = regex.sub(r"\s+", " ", m[0]).lower()
            out.append((len(regex.findall(M.ATOM.replace("\\s", " \n\t"), masked[: m.start()])), phrase, slug[phrase]))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_mentions_equal_one_alternation(spark, seed):
    r = random.Random(seed)
    names = sorted({(" ".join(r.choices(["al", "be", "ga", "b-e", "c++", "é1", "o'n", "&"], k=r.randint(1, 6))), None) for _ in range(40)})
    names = [(p, f"s{i}") for i, (p, _) in enumerate(names)]
    pieces = ["Al", "Be", "Ga", "al", "be", "B-e", "C++", "É1", "O'n", "&", "Al", "ga", "x", "[[Al]]", "`Be`", "\n", ".", "C++x", "_Al", "```Ga Al```"]
    texts = [(i, r.choice([" ", "  "]).join(r.choices(pieces, k=r.randint(0, 60)))) for i in range(150)] + [(150, None), (151, "Al" * 50_000), (152, "Al Be " * 3000)]
    got = M.mentions(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame(names, "phrase string, slug string"))
    want = sorted((i, *m) for i, t in texts for m in plain_mentions(t, names))
    assert sorted(map(tuple, got.collect())) == want and len(want) > 500


def test_mentions_by_hand(spark):
    names = spark.createDataFrame([("alpha beta", "ab"), ("beta gamma delta", "bgd"), ("one two three four five", "five"), ("ｍüller", "m"), ("mark", "mark"), ("müller", "mu")], "phrase string, slug string")
    texts = [(1, "Alpha beta gamma delta"), (2, "One two three four five"), (3, "alpha beta. Beta Gamma\nDelta"), (4, "ＭÜller and Mark"), (5, "Mark")]
    got = M.mentions(spark.createDataFrame(texts, "id int, text string"), M.usable_names(names.where("slug <> 'm'")))
    assert sorted(map(tuple, got.collect())) == [(1, 0, "alpha beta", "ab"), (2, 0, "one two three four five", "five"), (3, 3, "beta gamma delta", "bgd"), (4, 0, "müller", "mu")]
    links = M.mention_links(spark.createDataFrame([("ab", "Alpha Beta, Beta gamma delta; Beta Gamma Delta")], "id string, text string"), names)
    assert [tuple(x) for x in links.collect()] == [("ab", "bgd", 3)]


def test_queries_of_equal_terms_are_searched_once(spark):
    """Each query met all documents with its rarest term, so repeated questions made documents times queries rows."""
    docs = spark.createDataFrame([(i, f"alpha beta {'gamma' if i % 2 else 'delta'} filler{i}") for i in range(30)], "id int, text string")
    asked = [(1, "beta alpha gamma"), (2, "gamma alpha beta"), (3, "alpha gamma beta"), (4, "delta"), (5, "alpha absent")]
    terms = FT.numbered_terms(spark.createDataFrame(asked, "query_id int, query string"))
    words = FT.asked_words(docs.select("id", F.transform(F.split("text", " "), lambda w: F.struct(w.alias("term"), F.lit(1.0).alias("inverse"))).alias("words")), terms)
    assert words.count() == 30 * 3  # no filler goes on to the shuffle
    index = FT.positional_index(docs, "id", {"B": F.col("text")}, terms)
    whole = FT.positional_index(docs, "id", {"B": F.col("text")}).where("term NOT LIKE 'filler%'")
    assert sorted(index.collect()) == sorted(whole.collect())
    sets, members = FT.term_sets(index, terms)
    assert sorted(r.set_id for r in sets.collect()) == [1, 4]
    assert sorted(map(tuple, members.collect())) == [(1, 1), (1, 2), (1, 3), (4, 4)]
    one, many = (sorted(map(tuple, FT.set_hits(index, sets, size).collect())) for size in (FT.BLOCK_BYTES, 50))
    assert one == many and len(one) == 30
    hits = {(r.query_id, r.id, r["rank"]) for r in FT.keyword_arm(index, terms, 4).collect()}
    assert hits == {(q, 2 * n + 1, n + 1) for q in (1, 2, 3) for n in range(4)} | {(4, 2 * n, n + 1) for n in range(4)}


def test_title_arm_keeps_the_least_ids_of_a_title(spark):
    from tessera.operators import search as S

    docs = spark.createDataFrame([(i, "Same Title") for i in range(40, 0, -1)] + [(0, "same")], "id int, title string")
    queries = spark.createDataFrame([(1, "the same title"), (2, "same")], "query_id int, query string")
    got = sorted((r.query_id, r.id, r.score) for r in S.title_arm(docs, queries, 3).collect())
    assert got == [(1, 1, 2.0), (1, 2, 2.0), (1, 3, 2.0), (2, 0, 1.0)]


def test_held_words_and_the_best_of_each_task(spark, monkeypatch):
    """A document's postings come from its own row, with the same hits as over an index, whatever is worked on at once."""
    r = random.Random(5)
    docs = spark.createDataFrame([(i, " ".join(r.choices("abcdefgh", k=r.randint(1, 30)))) for i in range(200)] + [(200, None), (201, "")], "id int, text string").repartition(3)
    asked = [(i, " ".join(r.sample("abcdefgh", r.randint(1, 3)))) for i in range(60)] + [(60, "absent a")]
    terms = FT.numbered_terms(spark.createDataFrame(asked, "query_id int, query string"))
    words = F.split("text", " ")
    held = FT.held_words(docs, "id", {"A": F.slice(words, 1, 3), "B": words}, terms)
    assert held.count() == 200
    index = FT.positional_index(docs, "id", {"A": F.array_join(F.slice(words, 1, 3), " "), "B": F.col("text")}, terms)
    want = sorted((h.query_id, h.id, h.score, h["rank"]) for h in FT.keyword_arm(index, terms, 4).collect())
    everything = FT.cover_density_hits(index, terms).collect()
    best = {}
    for h in sorted(everything, key=lambda h: (-h.score, h.id)):
        best.setdefault(h.query_id, []).append((h.query_id, h.id, h.score, len(best.get(h.query_id, [])) + 1))
    assert want == sorted(x for rows in best.values() for x in rows[:4]) and len(want) == 240
    assert sorted((h.query_id, h.id, h.score, h["rank"]) for h in FT.held_arm(held, terms, 4).collect()) == want
    # a task that holds few rows passes on what it has and still drops nothing that counts
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(FT, "HELD_ROWS", 40)
    rows = [(h.query_id, h.id, h.score) for h in everything]
    best, out = FT.Best(61, 4), []
    for at in range(0, len(rows), 7):
        q, i, s = zip(*rows[at : at + 7], strict=True)
        out += best.add(np.array(q), pa.array(i), np.array(s))
    best.cut()
    got = [x for q, i, s in [*out, *best.rows] for x in zip(q.tolist(), i.to_pylist(), s.tolist(), strict=True)]
    assert len(got) < len(rows) and set(got) >= {x[:3] for x in want}


def test_hybrid_search_takes_texts_without_words(spark, tmp_path):
    """The first of no words was asked for, which is an error; now such a text has no title and asks for nothing."""
    from tessera import plans

    docs = [(i, f"quarry lantern number{i} meadow harbour", "src1", "en", 40) for i in range(40)] + [(40, "", "src1", "en", 0), (41, "?! --", "src1", "en", 5), (42, None, "src1", "en", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, source string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, [1.0, float(i)]) for i in range(42)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = plans.queries()["hybrid_search"](spark, str(tmp_path)).collect()
    assert {r.query_id for r in got} == {0, 20}


def test_longest_words(spark):
    from tessera.plans.search_queries import longest_words

    texts = [(1, "bb a ccc ccc BB dd ee"), (2, None), (3, "-"), (4, "é x"), (5, "zz yy xx ww")]
    got = {r.doc_id: r.longest for r in longest_words(spark.createDataFrame(texts, "doc_id int, text string"), 3).collect()}
    assert got == {1: ["ccc", "bb", "dd"], 4: ["x", "é"], 5: ["ww", "xx", "yy"]}
