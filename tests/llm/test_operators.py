"""The corpus operators against brute force, on small fixtures with nulls, empty and long texts, repeats and ties."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitweave.llm import decontaminate, html_text, jaccard, langid, license_scan, lm, packing, textcodes, tokenfile, tokens, topk, warc
from bitweave.llm.common import crc_mod
from bitweave.llm.components import components
from bitweave.llm.queries import tokenizer_path

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, n_words string, score string"


def low(text):
    return license_scan.lower_ascii(text or "")


def documents(spark, rows):
    """Documents with extra columns whose names clash with results."""
    return spark.createDataFrame([(i, t, "en", "x", None) for i, t in rows], DOCS).repartition(3)


def words_of(rng, n, vocabulary=60):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = words_of(rng, 80, 4000)
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, base), (5, base), (6, base + " tail"), (7, "Éa b"), (8, "a"), (9, words_of(rng, 6000)), (10, base.replace("w1", "W1") + "!")]
    rows += [(20 + k, words_of(rng, rng.randrange(1, 90), 500)) for k in range(30)]
    rows += [(60 + k, f"a {w} b") for k, w in enumerate(thue_morse())] + [(62, "one<|endoftext|>two <|endoftext|>"), (63, words_of(random.Random(6), 40, 500)), (63, words_of(random.Random(6), 40, 500))]
    return rows


def thue_morse(n=1024):
    """Two words with the same polynomial code modulo a power of two, whatever its base."""
    one = "".join("ab"[k.bit_count() % 2] for k in range(n))
    return one, one.translate(str.maketrans("ab", "ba"))


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_words_of_chunks():
    import pyarrow as pa

    rows = ["Hello World", None, "", "x", "é à", "1a-2b", "end", "start"] * 3
    for size in (1, 9, 1000):
        got = []
        for _, _, raw, at in textcodes.chunks(pa.array(rows), size):
            text, starts, stops, first, codes = textcodes.words(raw, at)
            found = [text[a:b].tobytes().decode() for a, b in zip(starts, stops, strict=True)]
            assert codes.tolist() == [textcodes.code_of(w) for w in found]
            got += [found[a:b] for a, b in zip(first, first[1:], strict=False)]
        assert got == [ALNUM.findall(low(t)) for t in rows]


@pytest.mark.parametrize("codes", [1 << 64, 40])
def test_pieces_make_the_library_ids(tokenizer, monkeypatch, codes):
    """Also where many pieces share a code."""
    if codes < 1 << 64:
        monkeypatch.setattr(tokens.Encoder, "_codes", staticmethod(lambda *word: textcodes.word_codes(*word) % np.uint64(codes)))
    rng = random.Random(1)
    parts = ["a", "B", "é", "ß", "1", "23", " ", "  ", "\n", "\n\n", "\t", ",", ".", "'s", "'", "don't", "<|endoftext|>", "\x01", " ", " ", "中文", "²", "Ⅷ", "_", "?!", ")", "\r\n", "…", " the", " Word"]
    rows = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(4000)] + [None, "", *thue_morse()]
    codec = tokens.Encoder(tokens.vocabulary(tokenizer_path()), keep=300)
    for k in range(0, len(rows), 500):
        for got, text in zip(codec.encode(rows[k : k + 500]), rows[k : k + 500], strict=True):
            assert np.frombuffer(got, "<u4").tolist() == tokenizer(text)[:-1], text


def test_word_codes_and_comparison():
    a, b = thue_morse()
    rows = [a, b, a, "x" * 70, "x" * 69 + "y", "x" * 64, "", "abcdefgh", "abcdefgi", "abcdefghi"]
    raw = np.frombuffer("".join(rows).encode(), np.uint8)
    size = np.array([len(r) for r in rows])
    at = np.cumsum(size) - size
    full = size > 0
    codes = textcodes.word_codes(raw, at[full], (at + size)[full])
    assert len(set(codes.tolist())) == len({r for r in rows if r})
    assert not set(codes.tolist()) & set(textcodes.word_codes(raw, at[full], (at + size)[full], 1).tolist())
    for k in range(len(rows)):
        same = textcodes.equal_words(raw, at, size, raw, np.roll(at, k), np.roll(size, k))
        assert same.tolist() == [x == y for x, y in zip(rows, rows[-k:] + rows[:-k] if k else rows, strict=True)]


def test_packing(spark, texts, tokenizer):
    pieces = packing.pack(documents(spark, texts), tokenizer_path(), capacity=64).collect()
    by, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        by[p.doc_id].append(p)
        sequences[p.sequence_id].append((p.offset, p.length))
    for i, text in texts:
        ids, at = tokenizer(text), 0
        for k, p in enumerate(sorted(by[i], key=lambda p: p.piece)[:: 2 if i == 63 else 1]):
            assert (p.piece, p.start, p.ids_crc32) == (k, at, crc(ids[at : at + p.length])) and (k == 0 or p.length == 64)
            at += p.length
        assert at == len(ids)
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64


def test_plan_places_everything():
    rng = random.Random(2)
    for _ in range(30):
        histogram = {n: rng.randrange(1, 40) for n in rng.sample(range(1, 65), rng.randrange(1, 40))}
        plan = packing.plan(histogram, 64)
        used = Counter()
        for pattern, times in plan:
            assert sum(pattern) <= 64 and times > 0
            for n in pattern:
                used[n] += times
        assert used == Counter(histogram)
        gaps = []  # best-fit decreasing, piece by piece
        for n in sorted((n for n, k in histogram.items() for _ in range(k)), reverse=True):
            fit = min((g for g in gaps if g >= n), default=None)
            if fit is not None:
                gaps.remove(fit)
            gaps.append((64 if fit is None else fit) - n)
        assert sum(t for _, t in plan) <= len(gaps)


def test_plan_is_made_of_exact_fills():
    """Where lengths have complements, they are met; the rest is packed best-fit and no sequence more than by best-fit alone."""
    rng = random.Random(3)
    assert packing.plan({40: 5, 24: 5, 30: 4, 20: 4, 14: 4, 64: 2}, 64) == [((64,), 2), ((40, 24), 5), ((30, 20, 14), 4)]
    for most in (64, 1024):
        histogram = {n: rng.randrange(1, 400) for n in range(1, most)}
        plan = packing.plan(histogram, most)
        exact = sum(t for p, t in plan if sum(p) == most and len(p) <= 4)
        alone = packing._best_fit(np.array([histogram.get(n, 0) for n in range(most + 1)]), most)
        assert sum(t for _, t in plan) <= sum(t for _, t in alone) and exact > 0.5 * sum(t for _, t in plan)


def test_license_scan(spark, texts):
    rows = [*texts, (100, "x CC\nby y, General  Public License. all rights reserved ALL RIGHTS RESERVED"), (101, "licensd under teh Apache license"), (102, "cc"), (103, "by")]
    found = {r.doc_id: r for r in license_scan.scan(documents(spark, rows)).collect()}
    for i, text in rows:
        w, places, labels = ALNUM.findall(low(text)), [], set()
        for phrase, label in license_scan.PHRASES.items():
            p = phrase.split()
            for k in range(len(w) - len(p) + 1):
                if w[k : k + len(p)] == p:
                    places.append(k)
                    labels.add(label)
        r = found[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(places), min(places, default=None), max(places, default=None), sorted(labels))
        assert set(r.base_labels) <= set(r.labels) and 0 <= r.score <= 1
    assert found[101].labels == ["apache"] and 0.8 < found[101].score < 1
    s = found[101].spans[0]
    assert s.edits == 3 and rows[-3][1][s.start : s.end].lower().startswith("licensd")
    assert found[20].labels == []


def test_notices_against_brute_force():
    """Every window of a notice's length and errors is tried, by edit distance."""
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = random.Random(9)
    notices = {"mozilla public license": "mpl", "released under the mit license": "mit"}
    scanner = license_scan.Notices(notices)
    for _ in range(60):
        notice = rng.choice(list(notices))
        text = list(notice)
        for _ in range(rng.randrange(6)):
            k = rng.randrange(len(text))
            text[k : k + 1] = rng.choice([[], [rng.choice("aeiz ")], [text[k], "q"]])
        text = "lorem " + "".join(text) + " ipsum"
        want = set()
        for n, label in notices.items():
            k = min(license_scan.MOST_ERRORS, len(n) // license_scan.CHARS_PER_ERROR)
            best = min(distance(n, text[a:b]) for a in range(len(text)) for b in range(a + len(n) - k, min(len(text), a + len(n) + k) + 1))
            if best <= k:
                want.add((label, best))
        assert {(s[0], s[3]) for s in scanner.spans(text)} == want
    many = scanner.spans("released under the mit license. " * 300)
    assert [s[1] for s in many] == list(range(0, 9600, 32))


def test_one_label_for_a_notice():
    scanner = license_scan.Notices(license_scan.NOTICES)
    for text, label in (("licensed under cc by-nc", "cc-by-nc"), ("licensed under the mit license", "mit"), ("apache license version 2.0", "apache"), ("this license is licensd", None)):
        assert [s[0] for s in scanner.spans(text)] == ([label] if label else [])


def test_notices_back_to_back():
    """A worse match beside a better one is reported as well, whichever comes first."""
    good, worse, worst = "released under the mit license", "releasd under the mit license", "releasd undr the mit license"
    notices = license_scan.Notices(license_scan.NOTICES)
    for parts in ([worse, good], [good, worse], [worst, worse, good], [worse, good, worst], [worst, worst]):
        text = ". ".join(parts)
        begin = [sum(len(p) + 2 for p in parts[:k]) for k in range(len(parts))]
        want = [("mit", a, a + len(p), len(good) - len(p)) for a, p in zip(begin, parts, strict=True)]
        assert [s[:4] for s in notices.spans(text)] == want


def test_language_id(spark):
    rng = random.Random(4)
    sounds = {"aa": "abcde", "oo": "mnopq", "uu": "stuvw"}
    rows = [(k, " ".join("".join(rng.choice(s) for _ in range(rng.randrange(2, 7))) for _ in range(12)), lang) for k, (lang, s) in enumerate(list(sounds.items()) * 60)]
    rows += [(1000, None, "aa"), (1001, "12 34 !", "aa"), (1002, "", None), (1003, "mnop", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    model = langid.fit(docs.where(crc_mod("doc_id", 4) != 2))
    assert model["labels"] == ["aa", "oo", "uu"] and (model["weights"] == 0).mean() > 0.5
    found = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    held = [r for r in rows if r[2] and r[0] < 1000 and zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert sum(found[i].lang_pred == lang for i, _, lang in held) >= 0.95 * len(held)
    assert all(found[i].lang_pred == "und" and found[i].score == 0 for i in (1000, 1001, 1002))
    assert found[1003].lang_pred == "oo" and 0 < found[1003].score <= 1
    empty = langid.fit(docs.where("false"))
    assert {r.lang_pred for r in langid.identify(docs, empty).collect()} == {"und"}


def test_language_features_and_training_by_hand():
    """TF-IDF of n-grams and follow-the-regularised-leader, coordinate by coordinate, against plain loops."""
    rng = random.Random(14)
    for text in ["", "a", "Ab 9-ß ÉÉ", words_of(rng, 50)]:
        found, n = langid.term_counts(text)
        plain = "".join(c if "a" <= c <= "z" or ord(c) > 127 else " " for c in text.lower())
        grams = Counter(plain[i : i + k] for k in langid.ORDERS for i in range(len(plain) - k + 1))
        assert n.sum() == sum(grams.values()) and len(found) <= len(grams)
        for g, times in grams.items():  # a feature has its n-grams' counts, more if others share it
            own = langid.term_counts(g)[0]
            assert len(g) < 1 or times <= max(n[np.searchsorted(found, own[-1])] if own[-1] in found else 0, n.max())
    rows = [(np.array(sorted(rng.sample(range(12), 4))), np.array([rng.random() for _ in range(4)]), rng.randrange(3)) for _ in range(20)]
    alpha, beta, l1, l2 = 0.5, 1.0, 0.02, 0.02
    z, n = defaultdict(float), defaultdict(float)

    def weight(i, c):
        return 0.0 if abs(z[i, c]) <= l1 else -(z[i, c] - math.copysign(l1, z[i, c])) / ((beta + math.sqrt(n[i, c])) / alpha + l2)

    order = np.random.default_rng(7)
    for _ in range(2):
        for k in order.permutation(len(rows)):
            at, x, label = rows[k]
            logits = [sum(weight(i, c) * v for i, v in zip(at.tolist(), x, strict=True)) for c in range(3)]
            total = sum(math.exp(v) for v in logits)
            steps = [(i, c, v * (math.exp(logits[c]) / total - (c == label)), weight(i, c)) for i, v in zip(at.tolist(), x, strict=True) for c in range(3)]
            for i, c, g, w in steps:
                z[i, c] += g - (math.sqrt(n[i, c] + g * g) - math.sqrt(n[i, c])) / alpha * w
                n[i, c] += g * g
    got = langid.train(rows, 3, epochs=2)
    assert all(got[i, c] == pytest.approx(weight(i, c), abs=1e-12) for i in range(12) for c in range(3)) and not got[12:].any()


def test_language_edge_cases(spark):
    """Long texts, repeated rows and ids, ties between labels, and too many labels."""
    rows = [(k, "abab " * 20 if k % 2 else "cdcd " * 20, "zz" if k % 2 else "yy") for k in range(40)] + [(1, "abab " * 20, "zz")] * 3
    rows += [(900, "abab " * 60_000, None), (901, "é", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    found = langid.identify(docs, model).collect()
    assert len(found) == len(rows) and {(r.lang_pred, round(r.score, 9)) for r in found if r.doc_id == 1}.__len__() == 1
    assert {r.lang_pred for r in found if r.doc_id == 900} == {"zz"}
    tied = dict(model, weights=np.zeros_like(model["weights"]))
    assert {(r.lang_pred, r.score) for r in langid.identify(docs, tied).collect()} == {("yy", 0.5)}
    with pytest.raises(ValueError, match="more than 1 labels"):
        langid.fit(docs, most_labels=1)


@pytest.mark.parametrize("stretch", [300, lm.STRETCH])
def test_lm_score(spark, texts, stretch):
    got = {r.doc_id: r for r in lm.score(documents(spark, texts), held_out=crc_mod("doc_id", 10) == 0, tune=crc_mod("doc_id", 10) == 1, stretch=stretch).collect()}
    words = {i: [*SPACE.findall(low(t)), None] for i, t in texts}
    held = {i: zlib.crc32(str(i).encode()) % 10 for i, _ in texts}
    train = [(i, words[i]) for i, _ in texts if held[i] != 0]  # a repeated row counts again
    c = Counter(x for _, w in train for x in w)
    total, kinds = sum(c.values()), len(c)
    tuned = [w for i, w in train if held[i] == 1]
    kept = [w for i, w in train if held[i] != 1]
    pairs = lambda w: list(zip([0, *w[:-1]], w, strict=True))

    def estimates(docs):
        one = Counter(x for w in docs for x in w)
        return one, Counter(p for w in docs for p in pairs(w)), one[None]

    def parts(model, pair):
        one, two, begins = model
        h, x = pair
        context = begins if h == 0 else one[h]
        return (context.bit_length(), two[pair] / context if context else 0.0, one[x] / max(1, sum(one.values())), 1 / (len([v for v in one.values() if v]) + 1))

    own, final = estimates(kept), estimates([w for _, w in train])
    rows = [parts(own, p) for w in tuned for p in pairs(w)]
    weights = {}
    for b in {parts(final, p)[0] for w in words.values() for p in pairs(w)} | {r[0] for r in rows}:
        weights[b] = None
    last = np.array([0.4, 0.5, 0.1])
    for b in range(max(weights) + 1):
        q = np.array([r[1:] for r in rows if r[0] == b])
        w = np.array([0.0, 0.9, 0.1]) if b == 0 else last / last.sum()
        for _ in range(100 if len(q) else 0):
            share = q * w
            new = np.maximum((share / share.sum(axis=1, keepdims=True)).mean(axis=0), [0, 1e-6, 1e-6])
            w = new / new.sum()
        if b and len(q):
            last = np.maximum(w, 1e-6)
        weights[b] = w
    for i, w in words.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i] == 0, len(w), sum(c[x] > 0 for x in w), total)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 0.1) / (total + 0.1 * (kinds + 1))) for x in w))
        ours = sum(math.log10(float(np.dot(weights[b], p))) for b, *p in (parts(final, p) for p in pairs(w)))
        assert r.score == pytest.approx(ours, rel=0.02)  # held-out counts are gathered in fine bins
    uniform = sum(len(w) for i, w in words.items() if held[i] == 0) * math.log10(1 / (kinds + 1))
    assert sum(r.score for r in got.values() if r.held_out) > uniform


def test_warc(spark):
    rows = [(5, "http://b.org/x", "same"), (3, "http://www.a.org/?q", "same"), (9, None, None), (8, "http://a.org/", ""), (2, "http://a.org/ü \n", "é" * 5000), (7, "bad url [", "same"), (None, "http://n.org", "same"), (3, "http://www.a.org/?q", "same"), (11, "http://z.org", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).repartition(3)
    archive = warc.write_archive(pages)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archive(archive).collect()), key=repr)
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        again = i is not None and i > first[h or ""]
        want.append((i, len(raw), warc.digest(raw), "revisit" if again else "response", first[h or ""] if again else None))
    assert got == sorted(want, key=repr)
    keys = [tuple(r) for r in archive["index"].orderBy("range", "place").select("urlkey", "time", "id").collect()]
    assert keys == sorted(keys) and len(keys) == len(rows)


def test_loser_tree():
    rng = random.Random(6)
    for k in range(12):
        runs = [sorted(rng.randrange(30) for _ in range(rng.randrange(9))) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_jaccard_chain(spark, monkeypatch):
    rng = random.Random(14)
    stream = [f"w{rng.randrange(100_000)}" for _ in range(2520)]
    rows = [(k, " ".join(stream[6 * k : 6 * k + 120])) for k in range(400)]  # a text is like the next two on both sides only
    sets = [{tuple(w[k : k + 5]) for k in range(116)} for w in (t.split() for _, t in rows)]
    links = [sum(a != b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for b in range(max(0, a - 20), min(400, a + 21))) for a in range(400)]
    assert max(links) == 4
    names = []
    monkeypatch.setattr(jaccard, "stored", lambda df, name, real=jaccard.stored: (names.append(name), real(df, name))[1])
    for block in (4, 256):
        names.clear()
        got = {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in jaccard.jaccard_classes(documents(spark, rows), block=block).collect()}
        assert got == {k: (0, links[k], 0) for k in range(400)}
        assert ("cells" in names) == (block == 4)  # small blocks: by buckets; large ones: as a whole


def test_jaccard_classes(spark, texts, monkeypatch):
    rng = random.Random(8)
    near = words_of(rng, 120, 5000).split()
    rows = list(texts)
    for k in range(24):  # a large group of near copies, over several blocks
        one = list(near)
        one[rng.randrange(120)] = f"n{k}"
        rows.append((200 + k, " ".join(one)))
    rows += [(300, "a b c"), (301, "A b, c"), (302, "a b c d"), (None, "a b c")]
    monkeypatch.setattr(jaccard, "BLOCK", 5)
    for limit in (0, 10_000):  # texts fetched by a shuffle and by a broadcast
        monkeypatch.setattr(jaccard, "BROADCAST_ROWS", limit)
        every = jaccard.jaccard_classes(documents(spark, rows)).collect()
        got = {r.doc_id: r for r in every}
        words = {i: tuple(ALNUM.findall(low(t))) for i, t in rows if i is not None}
        sets = {i: {w[k : k + 5] for k in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}
        root = {i: i for i in words}

        def top(x):
            while root[x] != x:
                x = root[x]
            return x

        links, copies = defaultdict(set), Counter({63: 1})  # a row that is there twice
        for a in words:
            for b in words:
                if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    x, y = sorted((top(a), top(b)))
                    root[y] = x
                    if words[a] == words[b]:
                        copies[a] += 1
                        copies[b] += 1
                    else:
                        links[a].add(words[b])
                        links[b].add(words[a])
        assert {i: (got[i].class_id, got[i].n_links, got[i].n_copies) for i in words} == {i: (top(i), len(links[i]), copies[i]) for i in words}
        assert got[None].class_id is None and Counter(r.doc_id for r in every) == Counter(i for i, _ in rows)


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(30)] + [(k, k + 1) for k in range(100, 120)] + [(7, 7)]
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        if u != v:
            a, b = sorted((top(u), top(v)))
            root[b] = a
    found = components(spark.createDataFrame(edges, "u long, v long"))
    assert {r.node: r.component for r in found.collect()} == {x: top(x) for x in root}
    assert components(spark.createDataFrame([], "u long, v long")).isEmpty()


def test_top_k(spark):
    rng = random.Random(10)
    rows = [(k, [rng.choice([-1.0, -0.3, 0.0, 0.25, 0.5]) for _ in range(6)]) for k in range(130)]
    rows += [(200, None), (201, [1.0, None]), (202, [float("nan")] * 6), (203, [float("inf")] * 6), (250, []), (251, [0.5]), (7, [0.5] * 6), (None, [1.0] * 6)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(0)).repartition(3)
    usable = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, a in usable:
        if q % 50 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in usable if i != q)
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:5])]
    for block in (2, 1000):
        assert sorted(tuple(r) for r in topk.top_k(table, block=block).collect()) == sorted(want)
    assert sorted(tuple(r) for r in topk.top_k(table, file_rows=7).collect()) == sorted(want)
    assert topk.top_k(table.where("false")).isEmpty()


def test_top_k_of_large_numbers(spark):
    """Scores near the ends of 64 bits are exact; beyond them they are an error."""
    big = float(1 << 23)  # 2**31 after scaling
    rows = [(50, [big, big, -1.0]), (1, [big, big - 1, 0.0]), (2, [big, -big, 1.0]), (3, [-big, -big, 0.0])]
    scores = {i: sum(int(256 * x) * int(256 * y) for x, y in zip(rows[0][1], v, strict=True)) for i, v in rows[1:]}
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.vec_id: r.score for r in got} == scores
    with pytest.raises(Exception, match="64 bits"):
        topk.top_k(spark.createDataFrame([(0, [2.0**33]), (1, [2.0**33])], "vec_id long, embedding array<double>")).collect()


def test_token_files(spark, texts, tokenizer):
    rows = [*texts, (-4, "first"), (8, "again"), (None, "lost")]
    found = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in tokenfile.token_files(documents(spark, rows), tokenizer_path(), shards=3).collect())
    at = 0
    assert len(found) == len(rows) - 1
    left = Counter((i, crc(tokenizer(t))) for i, t in rows if i is not None)
    for start, i, n, check in found:
        assert start == at
        left[i, check] -= 1
        at += n
    assert not any(left.values()) and [i for _, i, _, _ in found] == sorted(i for i, _ in rows if i is not None)


@pytest.mark.parametrize("nulls", [1, 40])
def test_token_files_without_keys(spark, texts, tokenizer, tmp_path, nulls):
    """op8 returns a row for each document; those without a key come first, in one shard or several."""
    from bitweave.llm.queries import QUERIES

    rows = [*texts, (8, "again"), *((None, f"lost {k}" if k % 3 else None) for k in range(nulls))]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in QUERIES["op8_token_files"](spark, str(tmp_path)).collect())
    at = 0
    for start, _, n, _ in found:
        assert start == at
        at += n
    assert [i for _, i, _, _ in found] == [None] * nulls + sorted(i for i, _ in rows if i is not None)
    assert Counter((i, c) for _, i, _, c in found) == Counter((i, crc(tokenizer(t))) for i, t in rows)


def test_index_tells_unknown_keys(spark, texts, tokenizer):
    store = tokenfile.write_tokens(documents(spark, texts), tokenizer_path(), shards=3)
    asked = spark.range(-500, 1500).withColumnRenamed("id", "doc_id")
    found = tokenfile.locate(spark, asked, store)
    assert {r.key for r in found.collect()} == {i for i, _ in texts} and store["keys"] == len({i for i, _ in texts})
    ids = {r.key: r.ids for r in tokenfile.read_tokens(found, store, payload=True).collect()}
    assert ids == {i: tokenizer(t) for i, t in texts}
    for n in (1, 2, 7, 1000):
        assert sorted(tokenfile.build(np.arange(n) * 13 - 5)[1]) == list(range(n))


def test_html_rules():
    """Classes count as wholes, for every element; the page itself is never dropped for its classes."""
    def kept(page):
        return [t for s, t in html_text.blocks(page) if s != html_text.DROP]

    assert kept("<head><title>x</title><meta charset=u><p>text <b>more</b>") == ["text more"]
    assert kept("<body class='no-sidebar menu'><article class='comment'>x</article>") == ["x"]
    assert kept("<article><p>a</p><p class='ad'>buy</p><p>b <span class=ad>no <span>deep</span> no</span> c</p><p class=cookie-notice>ck<p>d</article>") == ["a", "b c", "d"]
    assert kept("<section id='notice-of-motion'>s</section><div class='related-work'>r</div><div class='x related'>q</div>") == ["s", "r"]
    assert kept("<article><header>h</header>a<div id=comments><p>talk<div>more</div></div>z</article><p>out") == ["h", "a", "z"]
    assert kept("<ul role=navigation><li>1<li>2</ul>rest<input class=ad>k<script>x") == ["restk"]


def test_suffix_array():
    rng = np.random.default_rng(11)
    for _ in range(100):
        x = rng.integers(0, 3, rng.integers(1, 30))
        order, common = html_text.suffix_array(x)
        assert order.tolist() == sorted(range(len(x)), key=lambda i: x[i:].tolist())
        for a, b, n in zip(order, order[1:], common[1:], strict=False):
            p, q = x[a:].tolist(), x[b:].tolist()
            assert p[:n] == q[:n] and p[n : n + 1] != q[n : n + 1]


def test_html(spark):
    menu = "<div>" + " ".join(f"m{k}" for k in range(12)) + "</div>"
    rows = [(k, f"http://h.org/{k}", f"<html><body>{menu}<p>own{k} text{k} of page{k}</p><div class='ad'>buy</div></body></html>") for k in range(12)]
    rows += [
        (50, "http://a.org/1", "<head><title>no</title></head><nav><li>menu</nav><article><h1>A&amp;B</h1><p><b>one<br>two<p>three\n  &nbsp;four<aside>side</aside><div id=comments>talk</div></article><footer>end</footer>"),
        (51, None, None), (52, "x", "plain &lt; text"), (53, "http://q.org", "<script>var a='<p>'</script><article>" + "long " * 5000 + "</article>"), (None, "u", ""), (52, "x", "plain &lt; text"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).repartition(3)
    got = html_text.extract(pages).collect()
    text = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert text[50] == "A&B\none two\nthree four" and text[51] == text[None] == "" and text[52] == "plain < text"
    assert text[53] == " ".join(["long"] * 5000)
    assert all(text[k] == f"own{k} text{k} of page{k}" for k in range(12))


def brute_text(pages, least=html_text.LEAST):
    """Main text of (page id, host, open text) with distinct texts: words go that lie in a run of `least` which another text of the host has."""
    where = defaultdict(set)
    for _, h, t in pages:
        w = t.split()
        for k in range(len(w) - least + 1):
            where[h, tuple(w[k : k + least])].add(t)
    out = {}
    for i, h, t in pages:
        w = t.split()
        gone = {k + j for k in range(len(w) - least + 1) if len(where[h, tuple(w[k : k + least])]) > 1 for j in range(least)}
        out[i] = " ".join(x for k, x in enumerate(w) if k not in gone)
    return out


@pytest.mark.parametrize("group", [40, 300, html_text.GROUP])
def test_html_shares_across_groups(spark, group):
    """A block on two pages of a host goes however the host is split, and another host's pages don't matter."""
    rng = random.Random(21)
    runs = [" ".join(f"r{k}x{j}" for j in range(rng.randrange(6, 14))) for k in range(12)]
    pages = []
    for k in range(60):
        parts = [f"own{k}", *rng.sample(runs, 2), f"mid{k} more{k}", *([" ".join(f"b{k // 2}x{j}" for j in range(9))] if k < 20 else [])]
        rng.shuffle(parts)
        pages.append((k, f"h{k % 2 if k >= 20 else 2}.org", " ".join(parts)))
    rows = [(i, f"http://{h}/{i}", f"<body><p>{t}</p></body>") for i, h, t in pages]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), group=group).collect()}
    assert got == brute_text(pages)


@pytest.mark.parametrize("group", [40, html_text.GROUP])
def test_html_copies_keep_their_text(spark, group):
    """Copies under other ids and addresses, also with other adverts, are one page; what other pages share goes still."""
    menu = " ".join(f"menu{j}" for j in range(10))
    pages = [(k, "h.org" if k < 24 else "g.org", " ".join(f"c{k % 8}x{j}" for j in range(15)) + (" " + menu if k % 8 < 3 else "")) for k in range(32)]
    pages += [(40 + k, "one.org", " ".join(f"only{j}" for j in range(20))) for k in range(6)]
    ad = lambda i: f"<div class='ad'>buy{i} " + " ".join(f"a{i % 2}x{j}" for j in range(9)) + "</div>"
    rows = [(i, f"http://{h}/{i}", f"<body><p>{t}</p>{ad(i) if i % 3 == 0 else ''}</body>") for i, h, t in pages]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), group=group).collect()}
    assert got == brute_text(pages) and all(got[40 + k] == pages[-1][2] for k in range(6)) and got[3].endswith("c3x14") and got[0].endswith("c0x14")


@pytest.mark.parametrize("block", [60, 10_000])
def test_decontamination(spark, texts, block, monkeypatch):
    monkeypatch.setattr(decontaminate, "KEEP", 2)
    rng = random.Random(12)
    items = [(k, words_of(rng, n, 60)) for k, n in enumerate([1, 3, 8, 9, 20, 30])] + [(90, None), (91, "..."), (92, words_of(random.Random(5), 12, 4000)), (93, texts[8][1][:200])]
    items += [(None, "".join(f"n{k} " for k in range(9))), (None, None), (None, items[4][1])]
    rows = [*texts, (400, "x " + items[4][1] + " " + items[5][1].upper()), (401, items[1][1]), (402, "y " + items[10][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.decontaminate(documents(spark, rows), bench, block_chars=block).collect()}
    windows = defaultdict(set)
    for i, t in items:
        w = ALNUM.findall(low(t))
        for k in range(max(1, len(w) - 7) if w else 0):
            windows[tuple(w[k : k + 8])].update([] if i is None else [str(i)])
    for i, t in rows:
        w, hit, found = ALNUM.findall(low(t)), set(), set()
        for window, of in windows.items():
            for k in range(len(w) - len(window) + 1):
                if tuple(w[k : k + len(window)]) == window:
                    hit.update(range(k, k + len(window)))
                    found |= of
        assert (got[i].n_words, got[i].n_hit, got[i].item_ids) == (len(w), len(hit), sorted(found))


def test_contract_digest(spark, sf_dir):
    from bitweave.llm.queries import QUERIES

    clean = QUERIES["op10_decontaminate"](spark, sf_dir).where("n_items = 0").limit(1).collect()[0]
    assert clean.items_sha256 == hashlib.sha256(b"").hexdigest() and not clean.contaminated


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert packing.pack(none, tokenizer_path()).isEmpty()
    assert license_scan.scan(none).isEmpty()
    assert lm.score(none).isEmpty()
    assert jaccard.jaccard_classes(none).isEmpty()
    assert tokenfile.token_files(none, tokenizer_path()).isEmpty()
    assert decontaminate.decontaminate(none, spark.createDataFrame([], "item_id long, text string")).isEmpty()
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_text.extract(pages).isEmpty()
    assert warc.read_archive(warc.write_archive(pages)).isEmpty()
