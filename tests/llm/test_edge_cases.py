"""Nulls, empty and very long texts, ties, repeated rows, empty tables, and extra columns with clashing names."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import chat, decontam, langid, lm, packing, pii, quality, secret_scan, simhash, urlfilter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, label int, fp string, hits string, start string, row int"


def words(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefgh", k=r.randint(1, 7))) for _ in range(n))


def rows():
    texts = [(1, "the cat sat on the mat", "en"), (2, None, "en"), (3, "", None), (4, words(1, 30_000), "en"), (5, "123 456", None), (None, "le chat et la souris", "fr"),
             (6, "le chat et la souris", None), (6, "le chat et la souris", None), (7, "\n \t", "fr"), (8, "x", "fr"), (9, "ünï©ode 日本語 🙂 text", None), (10, "a" * 200_000, "en")]
    return [(i, t, lang, None if i == 1 else "s", None if t is None else len(t), 0.5, 1, "f", "h", "s", 3) for i, t, lang in texts]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "who sat on the mat? it was the cat of the house"), (2, None), (3, ""), (None, words(1, 40))], "item_id long, text string")


PER_ROW = {
    "langid": langid.identify, "quality": quality.judge, "simhash": simhash.near_duplicates, "pii": lambda d: pii.digest(pii.find_spans(d)), "lm": lm.score_documents,
}


@pytest.mark.parametrize("name", PER_ROW)
def test_one_row_for_each_row(docs, none, name):
    assert PER_ROW[name](none).collect() == []
    found = PER_ROW[name](docs)
    assert sorted(r[0] is None and -1 or r[0] for r in found.select("doc_id").collect()) == sorted(-1 if r[0] is None else r[0] for r in rows())
    same = found.where("doc_id = 6").collect()
    assert len(same) == 2 and same[0] == same[1]


def test_language_of_texts_without_letters(docs):
    found = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert all(found[i].lang_pred == "und" and found[i].score == 0 for i in (2, 3, 5, 7))
    assert found[None].held_out is None and found[1].lang_pred in ("en", "fr")
    assert all(0 <= r.score <= 1 for r in found.values())


def test_language_without_labels(spark, docs):
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert {r.doc_id for r in langid.in_known_language(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {None, 1, 4, 6, 8, 9, 10}


def test_fingerprints_of_wordless_texts(docs):
    found = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert {found[i].fingerprint for i in (2, 3, 7)} == {"0" * 16}
    assert {found[i].component_id for i in (2, 3, 7)} == {2}
    assert found[None].component_id == 6 and found[6].component_id == 6


def test_representatives_keep_one_row_a_group(docs, none):
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 4, 5, 6, 8, 9, 10]
    assert simhash.representatives(none).collect() == []


def test_pieces_of_empty_documents(docs, none):
    found = packing.pack_documents(docs).collect()
    assert packing.pack_documents(none).collect() == []
    assert sum(r.length for r in found if r.doc_id == 2) == 1 and {r.doc_tokens for r in found if r.doc_id == 3} == {1}
    assert sum(r.doc_id == 6 for r in found) == 2
    assert {r.doc_id for r in found} == {None, *range(1, 11)}


def test_leaks(docs, none, items):
    assert decontam.leaks(none, items).collect() == []
    assert decontam.leaks(docs, items.limit(0)).collect() == []
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(docs, items).collect()} == {(4, None)}
    clean = decontam.without_leaks(docs, items)
    assert clean.columns == docs.columns and clean.count() == len(rows()) - 1
    assert decontam.without_leaks(none, items).collect() == []


def test_secrets(spark, docs, none):
    assert secret_scan.scan(none).collect() == []
    masked = secret_scan.redacted(docs)
    assert masked.columns == docs.columns and masked.count() == len(rows())
    token = 'x token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" y token = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda".'
    one = spark.createDataFrame([(1, token, None), (1, token, None), (2, "plain", "a"), (3, None, None)], "doc_id long, text string, source string")
    got = sorted((r.doc_id, r.text or "") for r in secret_scan.redacted(one).collect())
    assert got == [(1, 'x token = "<secret>" y token = "<secret>".')] * 2 + [(2, "plain"), (3, "")]
    clash = one.select("*", *[F.lit(7).alias(c) for c in ("tessera_key", "tessera_spans", "length", "entropy", "start", "n_chars", "scanned")])
    again = secret_scan.redacted(clash).where("doc_id = 1").collect()
    assert secret_scan.redacted(clash).columns == clash.columns and all(r.n_chars == len(r.text) and r.tessera_spans == 7 and "<secret>" in r.text for r in again)


def test_secrets_of_any_length_and_without_digits(spark):
    r = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    long, plain = "".join(r.choices(letters + "0123456789+/", k=900)), "".join(r.choices(letters, k=30))
    assert secret_scan.find_candidates("Antidisestablishmentarianism floccinaucinihilipilification PNEUMONOULTRAMICROSCOPIC") == []
    rows = [(1, f'api token = "{long}" end', None), (2, f'password = "{plain}" end', None), (3, "the class AbstractMessageFactoryHandler is here", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {x.doc_id: x.text for x in secret_scan.redacted(docs).collect()} == {1: 'api token = "<secret>" end', 2: 'password = "<secret>" end', 3: rows[2][1]}


def test_urls(spark):
    urls = [(1, None), (2, "no scheme"), (3, "HTTP://WWW.Example.COM/en/7?x"), (4, "http://a.com/en/1#t"), (4, "http://a.com/en/1#t"), (None, "x://cheap-pills.org/"), (5, ""), (6, "a://b.de\n/x?y"), (7, "http://spam-farm.net/de/")]
    pages = spark.createDataFrame([(i, u, "h", "t", "r") for i, u in urls], "page_id long, url string, host string, token string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.filter_urls(pages).collect()}
    assert got == {1: ("", "", None, "allow"), 2: ("", "", None, "allow"), 3: ("www.example.com", "/en/7", "example.com/en/7", "allow"), 4: ("a.com", "/en/1", "com/en/", "block"),
                   None: ("cheap-pills.org", "/", None, "block"), 5: ("", "", None, "allow"), 6: ("b.de\n", "/x", None, "allow"), 7: ("spam-farm.net", "/de/", "net/de/", "allow")}
    assert urlfilter.filter_urls(pages).count() == len(urls)
    assert urlfilter.filter_urls(pages.limit(0)).collect() == []


def test_conversations(spark):
    turns = [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "assistant", "yo"), (3, 0, "user", "hi"), (3, 1, "assistant", "yo"), (4, 0, None, None), (4, 0, None, None), (None, 0, "user", "lost"),
             (5, 1, "b", "tie"), (5, 1, "a", "tie"), (6, None, "user", "z" * 100_000)]
    c = spark.createDataFrame([(*t, 1, "k") for t in turns], "conv_id long, turn long, role string, text string, k int, turns string")
    got = {r.conv_id: (r.n_turns, r.n_copies, r.text) for r in chat.format_conversations(c).collect()}
    assert got == {2: (2, 2, "<|user|>\nhi<|end|>\n<|assistant|>\nyo<|end|>\n"), 4: (1, 1, "<||>\n<|end|>\n"), 5: (2, 1, "<|a|>\ntie<|end|>\n<|b|>\ntie<|end|>\n"), 6: (1, 1, "<|user|>\n" + "z" * 100_000 + "<|end|>\n")}
    assert chat.format_conversations(c.limit(0)).collect() == []


def test_lm_rows(docs):
    found = {r.doc_id: r for r in lm.score_documents(docs).collect()}
    assert found[2].n_tokens == 1 == found[3].n_tokens and found[2].base_score == found[3].base_score
    assert found[None].held_out is None and all(r.score < 0 for r in found.values())


def test_pipeline_stages(spark, docs, none, tmp_path):
    bench = spark.createDataFrame([(1, words(1, 40))], "item_id long, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    known = {r.doc_id for r in langid.in_known_language(docs).collect()}
    assert {1, 6} <= known <= {None, 1, 4, 6, 8, 9, 10}
    # 4 holds the benchmark item; of the copies (null, 6, 6) the one with an id stays
    assert {r.doc_id for r in out} == known - {None, 4}
    d = none
    for name, stage in corpus_pipeline.STAGES:
        d2 = stage(spark, d, str(tmp_path))
        assert d2.collect() == [], name
        d = d2 if name != "packing" else d


def test_lm_with_nothing_to_learn_from(spark):
    import zlib

    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1]
    got = lm.score_documents(spark.createDataFrame([(i, "some text") for i in ids[:3]] + [(None, "more")], "doc_id long, text string")).collect()
    assert len(got) == 4 and all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 and r.score < 0 for r in got)


def test_pii_and_quality_of_one_hot_text(spark):
    docs = spark.createDataFrame([(i, "mail a@b.co now please it is late", "en") for i in range(300)], "doc_id long, text string, lang string")
    assert {(r.n_email, r.spans) for r in pii.digest(pii.find_spans(docs)).collect()} == {(1, "email:5:11")}
    assert {(r.n_words, r.base_failed) for r in quality.judge(docs).collect()} == {(7, True)}
    assert {r.component_id for r in simhash.near_duplicates(docs).collect()} == {0} and simhash.representatives(docs).count() == 1


def test_workers_drop_what_other_stages_built(monkeypatch):
    """Workers outlive stages: the encoder of packing stood beside the language model of a later stage."""
    from types import SimpleNamespace

    from tessera.llm import common

    def in_stage(k):
        monkeypatch.setattr(common, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(stageId=lambda: k)))

    monkeypatch.setattr(common, "_built", {})
    made = []
    build = lambda kind, key="k": common.built_once(kind, key, lambda: made.append(kind) or object())
    in_stage(1)
    first, other = build("encoder"), build("model")
    assert build("encoder") is first and build("model") is other and set(common._built) == {"encoder", "model"}
    in_stage(2)
    assert build("model") is other and set(common._built) == {"model"}
    assert build("encoder") is not first and made == ["encoder", "model", "encoder"]
    assert build("model", "new") is not other and set(common._built) == {"encoder", "model"}
