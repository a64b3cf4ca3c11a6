"""Operators against plain Python versions, round trips and held-out accuracy."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import decontam, langid, lm, near_copies, packing, pii, quality, secret_scan, simhash

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


def near_texts(n=400, seed=3):
    """Groups of near copies, many of them in one large group."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choices("abcdefghij", k=r.randint(2, 8))) for _ in range(300)]
    out = []
    base = [r.choices(vocabulary, k=120) for _ in range(6)]
    for i in range(n):
        text = list(base[0 if i % 2 else r.randrange(6)])
        for _ in range(r.randint(0, 2)):
            text[r.randrange(len(text))] = r.choice(vocabulary)
        out.append((i, " ".join(text)))
    return out


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def plain_components(ids_fps, sets=None):
    """Smallest ids of components: fingerprints within two bits, or (given shingle sets) a Jaccard similarity of 0.8."""
    root = {i: i for i, _ in ids_fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, a), (j, b) in itertools.combinations(ids_fps, 2):
        near = (a ^ b).bit_count() <= 2
        if not near and sets and sets[i] and sets[j]:
            near = len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
        if near:
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


@pytest.mark.parametrize("long_posting", [64, 4, 1])
def test_simhash_components(spark, long_posting):
    texts = near_texts() + [(1000, "one"), (1001, "ONE"), (1002, "two words"), (1003, None), (1004, " ")]
    got = simhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), long_posting=long_posting).collect()
    want = {i: plain_fingerprint(t) for i, t in texts}
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{f:016x}" for i, f in want.items()}
    assert {r.doc_id: r.component_id for r in got} == plain_components(list(want.items()))


@pytest.mark.parametrize("long_posting", [64, 4, 1])
def test_representatives_of_near_copies(spark, long_posting):
    """Copies with changed words, texts that share half their words without being copies, and short texts."""
    r = random.Random(11)
    texts = near_texts(200, seed=9)
    passage = r.choices(["alpha", "beta", "gamma", "delta", "epsilon", "zeta"], k=60)
    texts += [(500 + i, " ".join(passage + [f"own{i}w{j}" for j in range(60)])) for i in range(60)]
    texts += [(1000, "one"), (1001, "ONE"), (1002, "two words"), (1003, None), (1004, " ")]
    kept = simhash.representatives(spark.createDataFrame(texts, "doc_id long, text string"), long_posting=long_posting).collect()
    want = plain_components([(i, plain_fingerprint(t)) for i, t in texts], {i: plain_shingles(t) for i, t in texts})
    assert len(set(want.values())) > 60
    assert sorted(k.doc_id for k in kept) == sorted(set(want.values()))


def test_representatives_in_a_crowd_of_edited_copies(spark):
    """Variants of one text, most of them alike to it and few to each other, with chains that lead away from it."""
    r = random.Random(21)
    vocabulary = [f"v{i}" for i in range(500)]
    base = r.choices(vocabulary, k=200)
    texts = []
    for i in range(400):
        text = list(base)
        for _ in range(r.randint(1, 5)):
            text[r.randrange(200)] = r.choice(vocabulary)
        texts.append((i, " ".join(text)))
    for i in range(0, 400, 10):  # two steps on from a variant
        text = texts[i][1].split(" ")
        for k in (1, 2):
            for _ in range(3):
                text[r.randrange(200)] = r.choice(vocabulary)
            texts.append((1000 * k + i, " ".join(text)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    want = plain_components([(i, plain_fingerprint(t)) for i, t in texts], {i: plain_shingles(t) for i, t in texts})
    kept = simhash.representatives(df, long_posting=8).collect()
    assert sorted(k.doc_id for k in kept) == sorted(set(want.values()))


def test_simhash_links_of_random_and_chained_fingerprints(spark):
    r = random.Random(5)
    fps = {r.getrandbits(64) - (1 << 63) for _ in range(200)}
    for f in list(fps)[:60]:
        x = f & (1 << 64) - 1
        for _ in range(6):
            x ^= 1 << r.randrange(64) | 1 << r.randrange(64)
            fps.add(x - (1 << 64) if x >> 63 else x)
    ids = list(enumerate(sorted(fps)))
    df = spark.createDataFrame([(f,) for _, f in ids], "fp long")
    for long_posting in (64, 2):
        got = {x.node: x.root for x in simhash.components(simhash.links(df, long_posting)).collect()}
        want = plain_components([(i, f & (1 << 64) - 1) for i, f in ids])
        assert {i: got.get(f, f) for i, f in ids} == {i: dict(ids)[c] for i, c in want.items()}


def test_leaks(spark, documents):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    # an item longer than a passage stride, one altered beyond the limit, one altered within it
    long_item = " ".join(f"w{i}" for i in range(300))
    mended = [f"w{i}" for i in range(300)]
    mended[10] = "other"
    extra = [(9001, "x " * 77 + long_item + " y" * 50), (9002, " ".join(mended)), (9003, " ".join(f"w{i}" if i % 4 else "z" for i in range(300)))]
    docs = documents.select("doc_id", "text").unionAll(spark.createDataFrame(extra, "doc_id long, text string"))
    items = items.unionAll(spark.createDataFrame([(777, long_item), (778, "is this? yes it is")], "item_id long, text string"))
    for block_items in (20_000, 9):
        want = set()
        parts = {r.item_id: [decontam.shingles(p) for p in decontam.question_and_answer(r.text)] for r in items.collect()}
        for d in docs.collect():
            w = decontam.words_of(d.text)
            grams = {n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} for n in range(1, 6)}
            for item, (q, a) in parts.items():
                if all(len(p & grams[len(next(iter(p)))]) >= 0.8 * len(p) for p in (q, a)):
                    want.add((d.doc_id, item))
        blocks = list(decontam.index_blocks(items, block_items=block_items))
        assert len(blocks) > 1 or block_items > 100
        got = {(d.doc_id, h[0]) for index in blocks for d in docs.collect() for h in decontam.text_hits(d.text, index, decontam.THRESHOLD, decontam.OVERLAP)}
        assert got == want and (9001, 777) in got and (9002, 777) in got and (9003, 777) not in got
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(docs, items).collect()} == want
    assert {r.doc_id for r in decontam.without_leaks(docs, items).collect()} == {d.doc_id for d in docs.collect()} - {d for d, _ in want}


def test_block_max_wand_finds_all_above_threshold():
    r = random.Random(2)
    vocabulary = [f"v{i}" for i in range(80)]
    items = [(i, " ".join(r.choices(vocabulary, k=r.randint(3, 30)))) for i in range(300)]
    df = Counter(w for _, t in items for w in set(t.split()))
    index = decontam.ItemIndex(items, df, len(items), sum(len(t.split()) for _, t in items) / len(items))
    for _ in range(30):
        terms = sorted({index.vocabulary[w] for w in r.sample(vocabulary, 25) if w in index.vocabulary})
        for group in index.classes.values():
            exact = [sum(float(group.postings[t][1][group.postings[t][0] == i].sum()) for t in terms if t in group.postings) for i in range(len(group.items))]
            for threshold in (0.2, 0.5, 0.8):
                assert [i for i, _ in decontam.block_max_wand(group, terms, threshold)] == [i for i, s in enumerate(exact) if s >= threshold - 1e-9]


def test_packing_round_trip(spark, documents):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer_path())
    want = {d.doc_id: tokenizer.encode(d.text or "", add_special_tokens=False).ids + [1] for d in documents.collect()}
    pieces = packing.pack_documents(documents).collect()
    for p in pieces:
        ids = want[p.doc_id][p.start : p.start + p.length]
        assert len(ids) == p.length and p.ids_crc32 == zlib.crc32(np.array(ids, dtype="<u4").tobytes()) and p.doc_tokens == len(want[p.doc_id])
    assert Counter({i: len(x) for i, x in want.items()}) == Counter({i: sum(p.length for p in pieces if p.doc_id == i) for i in want})
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(p.length for p in pieces)
    assert total / (2048 * len(sequences)) > 0.97
    packed = {r.sequence_id: r for r in packing.packed_ids(documents).collect()}
    assert sum(r.length for r in packed.values()) == total and all(len(r.ids) == 4 * r.length for r in packed.values())


def test_word_encoder_equals_the_tokenizer():
    encoder = packing.WordEncoder(packing.default_tokenizer_path(), kept_words=50)
    r = random.Random(1)
    alphabet = "aAé ßÑ'stre.,!12½²İſŉ́e \x1c\x85 日本語 ’s'S<|>#\tΣς\n­ªº_-ǅ"
    texts = ["".join(r.choices(alphabet, k=r.randint(0, 40))) for _ in range(3000)] + ["<|endoftext|> hi", "a<|startoftext|>b", None, ""]
    for at in range(0, len(texts), 100):
        part = texts[at : at + 100]
        want = [np.array(encoder.tokenizer.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4").tobytes() for t in part]
        assert encoder.encode(part) == want


@pytest.mark.parametrize("seed", range(5))
def test_shortest_pack_first(seed):
    r = random.Random(seed)
    histogram = {r.randint(1, 100): r.randint(1, 500) for _ in range(40)} | {100: 7}
    patterns = packing.shortest_pack_first(histogram, 100)
    placed = Counter()
    for pattern, count in patterns:
        assert sum(pattern) <= 100 and count > 0
        for length in pattern:
            placed[length] += count
    assert placed == Counter(histogram)


def test_lm_base_scores_and_probabilities(spark, documents):
    docs = documents.select("doc_id", "text")
    got = {r.doc_id: r for r in lm.score_documents(docs, frequent_words=50).collect()}
    tokens = {d.doc_id: lm.normalised(d.text)[0] + [lm.END_WORD] for d in docs.collect()}
    counts = Counter(t for i, ts in tokens.items() if zlib.crc32(str(i).encode()) % 5 != 1 for t in ts)
    total, kinds = sum(counts.values()), len(counts)
    for i, ts in tokens.items():
        base = sum(math.log10((counts[t] + 0.5) / (total + 0.5 * (kinds + 1))) for t in ts)
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ts), sum(counts[t] > 0 for t in ts), total, zlib.crc32(str(i).encode()) % 5 == 1)
        assert r.base_score == pytest.approx(base, rel=1e-9)
    shorter = {r.doc_id: r.score for r in lm.score_documents(docs, order=2).collect()}
    held = [i for i, r in got.items() if r.held_out]
    assert sum(got[i].score for i in held) > 0.9 * sum(shorter[i] for i in held)


@pytest.mark.parametrize("frequent_arcs", [0, 40, 10**6])
def test_lm_automaton_against_direct_backoff(spark, frequent_arcs):
    texts = ["abra cadabra", "abra", "cab bar", "a b", "", None, "abacus bar", "zzz Cab é", "cadabra " * 200, "日本"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    learned = [lm.normalised(t)[1] for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 5 != 1]
    counts = {k: Counter() for k in range(1, 7)}
    for line in learned:
        line = b"\n" * 5 + line + b"\n"
        for i in range(5, len(line)):
            for k in counts:
                counts[k][line[i - k + 1 : i + 1]] += 1

    def chance(context, c):
        """Interpolated Witten-Bell over all contexts."""
        below = chance(context[1:], c) if context else 1 / 256
        seen = [n for g, n in counts[len(context) + 1].items() if g[:-1] == context]
        return below if not seen else (counts[len(context) + 1][context + c] + len(seen) * below) / (sum(seen) + len(seen))

    assert sum(chance(b"abra ", bytes([c])) for c in range(256)) == pytest.approx(1)
    got = {r.doc_id: r.score for r in lm.score_documents(docs, frequent_arcs=frequent_arcs).collect()}
    memory = {}
    for i, t in enumerate(texts):
        line, want = b"\n" * 5 + lm.normalised(t)[1] + b"\n", 0.0
        for k in range(5, len(line)):
            g = line[k - 5 : k + 1]
            memory[g] = memory.get(g) or math.log10(chance(g[:-1], g[-1:]))
            want += memory[g]
        assert got[i] == pytest.approx(want, rel=1e-9)


def test_lm_pieces_carry_the_state():
    lines = [b"abra cadabra", b"", b"cab " * 30, b"x"]
    whole = sorted(zip(*map(np.ndarray.tolist, lm.arcs_taken(next(lm.stretches(lines))))))
    for size in (1, 7, 50):
        assert sorted(p for g in lm.stretches(lines, size=size) for p in zip(*map(np.ndarray.tolist, lm.arcs_taken(g)))) == whole


def plain_base_spans(text):
    text = text or ""
    out = [(m.start(), 0, "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x if x < 5 else 2 * x - 9) for i, x in enumerate(d)) % 10 == 0:
            out.append((m.start(), 2, "card", m.end()))
    out += [(m.start(), 3, "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return [(a, b, k) for a, _, k, b in sorted(out)]


def test_pii_base_spans(documents):
    r = random.Random(4)
    texts = ["".join(r.choices("12345 .-+()@ab:4", k=r.randint(0, 60))) for _ in range(4000)] + [d.text for d in documents.collect()]
    texts += ["4111 1111 1111 1111 x", "a@b.c@d.e.f", "1.2.3.4.5.6.7.8", "300.1.1.1", "007.08.9.10", "+1 (017) 555-7713 x", "9" * 5000, "a" * 5000 + "@b"]
    for t in texts:
        assert pii.base_spans(t) == plain_base_spans(t), t[:80]


def test_pii_digest(spark):
    import hashlib

    text = "call +1 (017) 555-7713 or a@b.co, card 4111 1111 1111 1111"
    r = pii.digest(pii.find_spans(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"))).orderBy("doc_id").collect()
    spans = ",".join(f"{k}:{a}:{b}" for a, b, k in plain_base_spans(text))
    assert (r[0].n_email, r[0].n_ip, r[0].n_card, r[0].n_phone) == (1, 0, 1, 1)
    assert r[0].spans == spans and r[0].base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
    assert r[1].spans == "" and r[1].base_sha256 == hashlib.sha256(b"").hexdigest()


def test_pii_bootstrapping_discovers_identifiers_in_sure_contexts(spark):
    texts = [f"filler {i} please call me +1 (212) 555-{1000 + i} today" for i in range(40)]
    texts += [f"filler please call me 212-555-{3000 + i} today" for i in range(5)] + [f"part number is 212-555-{4000 + i} now" for i in range(5)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.added for r in pii.find_spans(docs).collect()}
    assert all(len(found[i]) == 1 and found[i][0].kind == "phone" and texts[i][found[i][0].start : found[i][0].end].startswith("212-555") for i in range(40, 45))
    assert all(not found[i] for i in (*range(40), *range(45, 50)))
    # the same context before other things is not sure
    noise = docs.unionAll(spark.createDataFrame([(100 + i, "please call me later today") for i in range(400)], "doc_id long, text string"))
    assert not any(r.added for r in pii.find_spans(noise).collect())


def test_pii_patterns_of_copied_documents(spark):
    """Five seeds, each in a document of many copies or many times in one text, are as sure as five single ones."""
    texts = [f"filler {i} please call me +1 (212) 555-{1000 + i} today" for i in range(5) for _ in range(50)]
    texts += [f"then write to us +1 (212) 555-{2000 + i} soon " * 50 for i in range(5)]
    texts += ["filler please call me 212-555-3000 today", "then write to us 212-555-3001 soon x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.added for r in pii.find_spans(docs).collect()}
    assert {i for i, added in found.items() if added} == {255, 256}
    assert pii.learned_patterns(docs) == pii.learned_patterns(docs, block_patterns=1) != []


def plain_quality(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    seen = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if seen[x] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n


def test_quality_base(spark, documents):
    r = random.Random(6)
    extra = [(5000 + i, "".join(r.choices("ab \n#|\x85\u2028é", k=r.randint(0, 200))), "en") for i in range(150)]
    docs = documents.select("doc_id", "text", "lang").unionAll(spark.createDataFrame(extra, "doc_id long, text string, lang string"))
    want = {d.doc_id: plain_quality(d.text) for d in docs.collect()}
    for x in quality.judge(docs).collect():
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) == want[x.doc_id]
        assert not (x.base_failed and x.kept)


def test_quality_verdicts_on_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = quality.judge(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed").toPandas()
    assert got[got.quality == 1].kept.mean() > 0.99
    long = got[got.n_words >= quality.MIN_WORDS]
    assert (~long[long.quality == 0].kept).mean() > 0.9


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").toPandas()
    assert len(got) > 100 and (got.lang == got.lang_pred).mean() > 0.97


def test_cross_parsing_counts_longest_matches():
    r = random.Random(8)
    sample = {"x": ["".join(r.choices("abc", k=60)) for _ in range(3)], "y": ["".join(r.choices("bcd", k=60)) for _ in range(3)]}
    model = langid.LanguageModel(sample)
    for _ in range(20):
        text = "".join(r.choices("abcde", k=r.randint(1, 200)))
        got = model.phrases([model.fold(text)[0]])[0]
        for i, lang in enumerate(model.languages):
            phrases, at = 0, 0
            while at < len(text):
                n = next((n for n in range(len(text) - at, 0, -1) if any(text[at : at + n] in p for p in sample[lang])), 1)
                at += n
                phrases += 1
            assert got[i] == phrases


def test_cross_parsing_is_not_changed_by_blocks():
    """Long texts, texts copied from the sample (phrases longer than a block), and scripts of many letters."""
    r = random.Random(9)
    han = [chr(0x4E00 + i) for i in range(400)]
    sample = {"x": ["".join(r.choices("abc ", k=300))], "y": ["".join(r.choices("bcdé ", k=300))], "z": ["".join(r.choices(han, k=900))]}
    model = langid.LanguageModel(sample)
    texts = ["".join(r.choices("abcdé .", k=n)) for n in (1, 15, 16, 17, 700, 3000)] + [sample["x"][0], sample["y"][0][50:] * 3, "a" * 100, "".join(r.choices(han, k=200)), sample["z"][0] + "a"]
    lines = [model.fold(t)[0] for t in texts]
    whole = model.phrases(lines, block=10**6)
    for block in (16, 64, langid.BLOCK):
        assert (model.phrases(lines, block=block) == whole).all()
    for i, t in enumerate(texts[:8]):
        line = model.own[0][lines[i]]
        folded, first = "".join(map(chr, line + 65)), "".join(map(chr, model.own[0][model.fold(sample["x"][0])[0]] + 65))
        phrases, at = 0, 0
        while at < len(folded):
            n = at
            while n < len(folded) and line[n] != langid.OTHER and folded[at : n + 1] in first:
                n += 1
            at = max(n, at + 1)
            phrases += 1
        assert whole[i, 0] == phrases


def plain_distance(p, q):
    """Jensen-Shannon distance from the definition, key by key."""
    total = 0.0
    for k in p.keys() | q.keys():
        m = (p.get(k, 0) + q.get(k, 0)) / 2
        total += sum(0.5 * x * math.log2(x / m) for x in (p.get(k, 0), q.get(k, 0)) if x)
    return math.sqrt(max(0.0, total))


def test_quality_divergence_against_plain_histograms(spark, documents):
    """Shares, references and distances by dictionaries, with the common words that the operator fitted."""
    docs = documents.select("doc_id", "text", "lang")
    labelled = docs.where("lang is not null and text is not null").select("lang", "text")
    common = quality.common_words(labelled)

    def kind(c):
        return 5 if c in quality.PROSE_MARKS else 0 if c.isalpha() and c.islower() else 1 if c.isalpha() and c.isupper() else 2 if c.isalpha() else 3 if c.isdigit() else 4 if c.isspace() else 6

    def shares(text, lang):
        w = [x.lower() for x in text.encode().split()]
        chars, n = Counter(map(kind, text)), len(w)
        words = Counter(x if x in set(common[lang]) else None for x in w)
        return {k: c / len(text) for k, c in chars.items()}, {k: c / n for k, c in words.items()}

    means = {}
    for lang in common:
        rows = [shares(d.text, lang) for d in labelled.where(F.col("lang") == lang).collect() if len(d.text.split()) >= quality.MIN_WORDS]
        means[lang] = [{k: sum(r[i].get(k, 0) for r in rows) / len(rows) for k in set().union(*(r[i] for r in rows))} for i in (0, 1)]
    texts = {d.doc_id: d.text or "" for d in docs.collect()}
    for x in quality.judge(docs).collect():
        if x.n_words < quality.MIN_WORDS:
            assert x.char_distance is None and x.kept == (not x.base_failed)
            continue
        char = min(plain_distance(shares(texts[x.doc_id], lang)[0], means[lang][0]) for lang in means)
        word = min(plain_distance(shares(texts[x.doc_id], lang)[1], means[lang][1]) for lang in means)
        assert x.char_distance == pytest.approx(char, abs=1e-9) and x.word_distance == pytest.approx(word, abs=1e-9)
        assert x.kept == (not x.base_failed and char <= quality.MAX_CHAR_DISTANCE and word <= quality.MAX_WORD_DISTANCE)


def test_pii_totals_count_spans_of_several_words(spark):
    docs = spark.createDataFrame([(1, "call me +1 (212) 555 1000 today or me x today; me today"), (2, "me a b c d e f g today me " + "w " * 20 + "today")], "doc_id long, text string")
    got = {r.pattern: r.total for r in pii.occurrences(docs, ["<> me today", "<< call me"]).collect()}
    assert got == {"<> me today": 3, "<< call me": 1}
    long = "x" * 5000
    assert pii.contexts(f"a {long} 1 z", 5003, 5004) == [f"<< a {long}", f"<> {long} z"]


def test_secret_forest_on_held_out_findings(spark):
    model = secret_scan.learn(secret_scan.labelled_findings(spark))
    held = secret_scan.labelled_findings(spark, each=40, seed=99).collect()
    x = spark.createDataFrame([(r.label, *secret_scan.features(r.before, r.candidate, r.after, r.place)) for r in held], ["label", *secret_scan.FEATURES])
    right = model.transform(x).where(F.col("label") == F.col("prediction")).count()
    assert right / len(held) > 0.95


def test_secrets_planted_in_documents(spark):
    """Planted secrets are found and look-alikes left alone in documents; candidates are those of a plain re-scan."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").where("text is not null and doc_id < 60")
    r = random.Random(12)
    pick = lambda alphabet, n: "".join(r.choices(alphabet, k=n))
    alnum = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    planted, rows = {}, []
    for d in docs.collect():
        good = d.doc_id % 2 == 0
        what = pick(alnum, 40) if good else r.choice(["-".join(pick("0123456789abcdef", n) for n in (8, 4, 4, 4, 12)), "app/models/user_session/index_page.py"])
        words = d.text.split(" ")
        at = r.randrange(len(words) + 1)
        planted[d.doc_id] = (what, good)
        rows.append((d.doc_id, " ".join(words[:at] + [(f'secret_key = "{what}"' if good else f"commit {what}")] + words[at:]), d.source))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found, texts = secret_scan.scan(df).collect(), {i: t for i, t, _ in rows}
    runs = re.compile(r"[A-Za-z0-9+/_=.-]{16,}")
    for i, t in texts.items():
        got = {t[f.start : f.start + f.length] for f in found if f.doc_id == i}
        plain = {m[0].rstrip(".") for m in runs.finditer(t)}
        plain = {x for x in plain if len(x) >= 16 and "=" not in x.rstrip("=") and not (x.isalpha() and (x.isupper() or x[1:].islower()))}
        assert got == plain
    hit = {(f.doc_id, texts[f.doc_id][f.start : f.start + f.length]) for f in found if f.is_secret}
    assert all(((i, what) in hit) == good for i, (what, good) in planted.items())


def test_urls_against_every_rule_on_every_url(spark):
    from tessera.llm import urlfilter

    r = random.Random(2)
    parts = ["login", "redirect", "xredirect", "redirect=", "phpsessid=", "JSESSIONID=", "xphpsessid=", "af09", "spam-farm.", "xspam-farm.", "cheap-pills.", "ads-track.com", "www.", "a.com", "/", "?", "&", "#", "://", "http", ".", "=", "-", "é", "İ", "LOGIN", "casino-win.org"]
    urls = {"https://a.com/login?xredirect=1", "https://a.com/?phpsessid=1", "http://www.SPAM-FARM.de/"} | {"http://" + "".join(r.choices(parts, k=r.randint(1, 9))) for _ in range(3000)}
    pages = spark.createDataFrame(list(enumerate(sorted(urls))), "page_id long, url string")
    got = {x.page_id: x.pattern_rule for x in urlfilter.filter_urls(pages).collect()}
    for i, u in enumerate(sorted(urls)):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in u)
        assert got[i] == min((x.rule_id for x in urlfilter.PATTERN_RULES if re.search(x.pattern, low)), default=None), u
    assert len({x for x in got.values() if x}) == len({x.rule_id for x in urlfilter.PATTERN_RULES}) - 2
    for pattern, tokens in ((r"[?&](a|b)=1", ()), (r"/login[/?][^#]*redirect=", ("redirect",)), (r"x*login/", ("login",)), (r"/login", ("login",))):
        with pytest.raises(ValueError):
            urlfilter.PatternRule("r", pattern, tokens)


def test_pipeline_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    d = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, sf).cache()
        assert d.columns == docs.columns
        kept[name] = {r.doc_id: r.text for r in d.collect()}
    first = kept["language_id"]
    groups = plain_components([(i, plain_fingerprint(t)) for i, t in first.items()], {i: plain_shingles(t) for i, t in first.items()})
    assert set(kept["near_dedup"]) == set(groups.values())
    benchmark = [[decontam.shingles(p) for p in decontam.question_and_answer(r.text)] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    grams = {i: decontam.shingles(decontam.words_of(t)) for i, t in kept["near_dedup"].items()}
    leaking = {i for i, g in grams.items() if any(all(len(p & g) >= 0.8 * len(p) for p in parts) for parts in benchmark)}
    assert set(kept["decontamination"]) == set(kept["near_dedup"]) - leaking
    masked = {i: re.sub(r'(token = ")[0-9a-f]{40}"', r'\1<secret>"', t) for i, t in kept["decontamination"].items()}
    assert kept["secrets"] == masked
    pieces = corpus_pipeline.run(spark, sf).collect()
    assert {p.doc_id for p in pieces} == set(masked)


@pytest.mark.parametrize("words", [60, 200])
def test_representatives_of_a_thousand_near_copies(spark, words):
    """One crowded group at production settings: with two or three words of 200 changed most pairs are near; with three of 60 few are."""
    r = random.Random(words)
    vocabulary = [f"v{i}" for i in range(3000)]
    base = r.choices(vocabulary, k=words)
    texts = []
    for i in range(1200):
        text = list(base)
        for _ in range(r.randint(1, 3)):
            text[r.randrange(words)] = r.choice(vocabulary)
        texts.append((i, " ".join(text)))
    want = plain_components([(i, plain_fingerprint(t)) for i, t in texts], {i: plain_shingles(t) for i, t in texts})
    kept = simhash.representatives(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert sorted(k.doc_id for k in kept) == sorted(set(want.values()))


def test_a_pair_of_eight_tenths_is_never_refused_by_its_bitmap():
    r = np.random.default_rng(4)
    for n in (1, 5, 40, 900, 6000):
        p = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
        for drop in {0, n // 20, n // 10, n // 5}:
            q = np.unique(np.concatenate([p[drop:], r.integers(0, 2**63, drop // 3, dtype=np.uint64)]))
            common = len(np.intersect1d(p, q))
            if common >= 0.8 * (len(p) + len(q) - common):
                differing = np.bitwise_count(near_copies.parity(p) ^ near_copies.parity(q)).sum()
                assert differing <= (0.2 / 1.8) * (len(p) + len(q)) + 1e-6


def jobs_of(spark, group, run):
    """What ``run`` gives, and how many jobs the driver took for it."""
    spark.sparkContext.setJobGroup(group, group)
    try:
        return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_components_take_few_jobs_of_the_driver(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(6)] + [(20, 21), (30, 30)], "a long, b long")
    assert sorted(simhash.components(path).where("node <> root").collect()) == [(i, 0) for i in range(1, 7)] + [(21, 20)]
    none, jobs = jobs_of(spark, "components of nothing", lambda: simhash.components(path.where("a = b")).collect())
    assert none == []
    assert jobs <= 5


def test_differing_bytes(spark):
    from tessera.llm.near_copies import differing_bytes

    edges = [0, 1, -1, 127, 128, 255, 256, (1 << 63) - 1, -(1 << 63), 1 << 56, -(1 << 56), (1 << 56) - 1, 0x0101010101010101, 0x7F7F7F7F7F7F7F7F, -0x7F7F7F7F7F7F7F80]
    rng = random.Random(5)
    longs = edges + [sum(rng.choice((0, 1, 128, rng.randrange(256))) << 8 * i for i in range(8)) - (1 << 63) for _ in range(40)]
    pairs = spark.createDataFrame([(a, b) for a in longs for b in longs], "a long, b long")
    for r in pairs.select("a", "b", differing_bytes(F.col("a"), F.col("b")).alias("n"), simhash.byte_tally(F.col("a"), F.col("b")).alias("same")).collect():
        want = sum(x != y for x, y in zip(r.a.to_bytes(8, "little", signed=True), r.b.to_bytes(8, "little", signed=True), strict=True))
        assert (r.n, r.same) == (want, 8 - want)
