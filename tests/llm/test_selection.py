"""Importance resampling, spelling variants and language identification against brute force and held-out accuracy."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexmill.llm import importance as IR
from lexmill.llm import language_id as LI
from lexmill.llm import secret_scan as SS
from lexmill.llm import spelling as SP
from lexmill.llm.scratch import Scratch

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, weight long, word string, n long, key string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "Ren", "tÜ", "ç9"]) for _ in range(rng.randrange(1, 6)))
    texts = [" ".join(word() for _ in range(rng.randrange(1, 80))) for _ in range(60)]
    odd = [None, "", " .. !", "x" * 300 + " " + "y" * 65 + " É!a" + "z" * 64, "Ab-cD loloKami " * 120_000, "ÀB_c\x00d 7", "w" * 2_000_000 + " ende der langen", "word " * 20]
    made = [(i, t) for i, t in enumerate([*texts, *odd])]
    return [*made, made[3], made[3]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    every = [(d, t, [None, "en", "fr"][d % 3], 1, "clash", 2, "clash") for d, t in rows]
    return spark.createDataFrame(every, SCHEMA).repartition(3)


def resampled(rows, target, percent):
    find = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall

    def features(text):
        w = find((text or "").translate(LOW))
        return len(w), Counter(zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1))

    each = [(d, *features(t)) for d, t in rows]
    s, t = Counter(), Counter()
    for _, _, c in each:
        s.update(c)
    for x in target:
        t.update(features(x)[1])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10000) / ((s[b] + 1) * (t.total() + 10000)))) for b in range(10000)]
    out = []
    for d, n, c in each:
        weight, h = sum(gain[b] * k for b, k in c.items()), int(hashlib.sha256(f"42:{d}".encode()).hexdigest()[:8], 16)
        out.append([d, n, c.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    some = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0]))
    for i, r in enumerate(some[: percent * len(some) // 100]):
        r[5] = i + 1
    return sorted(map(tuple, out), key=repr)


@pytest.mark.parametrize("percent", [5, 37, 100])
def test_importance_is_brute_force(spark, docs, rows, percent):
    target = [(None, None), ("kalo mi É tÜ", 1), ("", 2)]
    found = IR.importance_resample(spark, docs, spark.createDataFrame(target, "text string, doc_id long"), percent)
    got = sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_features", "weight", "score", "rank")) for r in found.collect()), key=repr)
    assert got == resampled(rows, [x for x, _ in target], percent)


def test_importance_parts_and_empty_tables(spark, docs):
    same = lambda n: sorted(map(tuple, IR.importance_resample(spark, docs.repartition(n), docs.limit(0), 20).collect()), key=repr)
    assert same(1) == same(7)
    assert IR.importance_resample(spark, docs.limit(0), docs).count() == 0
    null_id = spark.createDataFrame([(None, "a b c"), (None, None)], "doc_id long, text string")
    assert [r["n_features"] for r in IR.importance_resample(spark, null_id, null_id).orderBy("n_features").collect()] == [0, 6]


def test_crc_of_runs_across_stretches(monkeypatch):
    monkeypatch.setattr(IR, "PIECE", 50)
    rng = random.Random(8)
    texts = [" ".join("é" * rng.randrange(0, 3) + "b" * rng.choice([1, 2, 130]) for _ in range(rng.randrange(60))) for _ in range(9)]
    data, off = IR.buffer_of(pa.array(texts))
    got = Counter()
    for _, text, crc in IR._features(IR.FOLD[data], off, 3):
        got.update(zip(text.tolist(), crc.tolist(), strict=True))
    words = [t.split() for t in texts]
    assert got == Counter((i, zlib.crc32(" ".join(w[j : j + k]).encode())) for i, w in enumerate(words) for k in (1, 2, 3) for j in range(len(w) - k + 1))


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def variants(rows, every):
    n = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            r = run.translate(LOW)
            h = zlib.crc32(f"{d}:{r}".encode())
            n[r[: h % len(r)] + r[h % len(r) + 1 :] if h % every == 0 else r] += 1
    words = {w: c for w, c in n.items() if c >= 2 and len(w) >= 7}
    near = {w: [x for x in words if x != w and abs(len(x) - len(w)) <= 1 and one_edit(w, x)] for w in words}
    best = {w: min(xs, key=lambda x: (-words[x], x)) for w, xs in near.items() if xs}
    form = {w: x for w, x in best.items() if words[x] >= 10 * words[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, c, len(near[w]), form.get(w), words.get(form.get(w)), root(w)) for w, c in words.items())


@pytest.mark.parametrize("every", [31, 2])
def test_spelling_is_brute_force(spark, every):
    rng = random.Random(5)
    made = ["".join(rng.choice("abÿ×") for _ in range(rng.choice([7, 8, 9, 12]))) for _ in range(30)]
    texts = []
    for _ in range(400):
        w = made[min(29, int(rng.expovariate(0.4)))]
        for _ in range(rng.randrange(3)):
            k, op = rng.randrange(len(w)), rng.random()
            w = w[:k] + (rng.choice("abÉ") if op > 0.2 else "") + w[k + (op < 0.6) :]
        texts.append(f"{w} {w}, {w.upper()}")
    rows = [*enumerate(texts), (5, texts[5]), (None, texts[7]), (1000, None), (1001, ""), (1002, "abaaaaa" * 3 + " " + "b" * 90_000 + " " + "b" * 90_000), (1003, "b" * 90_001 + " " + "b" * 90_001), (1004, "chaaaaa " * 2 + "chaaaab " * 25 + "chaaabb " * 300)]
    table = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], "doc_id long, text string, word string, near long").repartition(4)
    got = sorted(map(tuple, SP.spelling_variants(spark, table, every).select("word", "n", "n_near", "form", "form_n", "root").collect()))
    want = variants([("" if d is None else d, t) for d, t in rows], every)
    assert got == want
    assert every == 2 or any(r[3] and r[5] != r[3] for r in want), "a chain of forms"


@pytest.mark.parametrize("part", [2048, 3])
def test_near_words_of_all_lengths(spark, monkeypatch, part):
    rng, words = random.Random(6), set()
    for _ in range(150):
        w = "".join(rng.choice("abÿ") for _ in range(rng.choice([7, 8, 9, 10, 12, 39, 40, 41, 42, 43, 60, 200])))
        words.add(w)
        for _ in range(6):
            k, op = rng.randrange(len(w)), rng.randrange(3)
            words.add(w[:k] + (rng.choice("abÿ") if op else "") + w[k + (op != 2) :])
    words = sorted(w for w in words if len(w) >= 7)
    monkeypatch.setattr(SP, "PART", part)
    table = spark.createDataFrame([(w, i + 2) for i, w in enumerate(words)], "word string, n long").repartition(5)
    got = sorted(map(tuple, SP.near_words(spark, table, Scratch(spark, "near")).collect()))
    assert got == sorted((a, i + 2, b, j + 2) for i, a in enumerate(words) for j, b in enumerate(words) if a != b and abs(len(a) - len(b)) <= 1 and one_edit(a, b))


def test_spelling_of_nothing(spark, docs):
    assert SP.spelling_variants(spark, docs.limit(0)).count() == 0
    lone = spark.createDataFrame([(1, "lonely lonelyword lonelyword")], "doc_id long, text string")
    assert [(r["n_near"], r["form"]) for r in SP.spelling_variants(spark, lone, 10**9).collect()] == [(0, None)]


def sentences(rng, lang, n):
    heads = {"en": ["the", "of", "and", "thing", "wh"], "de": ["der", "und", "sch", "ung", "ein"], "fr": ["le", "des", "eau", "tion", "é"], "es": ["el", "los", "ción", "ñ", "que"], "fi": ["on", "kää", "nen", "sta", "yö"]}[lang]
    return " ".join("".join(rng.choice(heads) for _ in range(rng.randrange(1, 4))) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def tongues(spark):
    rng = random.Random(2)
    made = [(i, sentences(rng, (lang := rng.choice(["en", "de", "fr", "es", "fi"])), rng.choice([1, 5, 40, 200])), lang) for i in range(600)]
    odd = [(1000, None, "en"), (1001, "", "de"), (1002, "12 -- 34 €", "en"), (1003, "7" * 10, None), (1004, sentences(rng, "de", 200_000), None), (1005, "é", "fr"), (None, "the thing", "en"), (0, made[0][1], made[0][2])]
    return made, spark.createDataFrame([(d, t, x, "clash", 0.5) for d, t, x in [*made, *odd]], "doc_id long, text string, lang string, lang_pred string, score double").repartition(4)


def test_languages_of_held_out_texts(spark, tongues):
    made, table = tongues
    found = LI.identify(spark, table, per_language=100)
    got = {r["doc_id"]: r for r in found.collect()}
    assert all(got[d]["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) for d, _, _ in made)
    out = [(d, x) for d, t, x in made if got[d]["held_out"] and len(t) > 20]
    assert sum(got[d]["lang_pred"] == x for d, x in out) >= 0.98 * len(out) > 60
    assert all(0 <= r["score"] <= 1 for r in got.values())
    for d in (1000, 1001, 1002, 1003):
        assert (got[d]["lang_pred"], got[d]["score"]) == ("und", 0)
    assert got[1004]["lang_pred"] == "de" and got[1005]["lang_pred"] != "und" and got[None]["lang_pred"] == "en"
    assert found.count() == table.count()


def test_predictions_hang_on_texts_alone(spark, tongues):
    """Neither lang, doc_id nor the parts of a held-out document's table bear on its prediction."""
    _, table = tongues
    model = LI.train(table.where("doc_id < 1000"), 50)
    assert model.labels == ["de", "en", "es", "fi", "fr"] and sorted(map(sorted, model.families)) == [[0, 1], [2, 4], [3]]
    def predicted(rows):
        texts = rows.select("doc_id", "text")
        return {r["text"]: (r["lang_pred"], r["score"]) for r in LI.predict(spark, texts, model).join(texts, "doc_id").collect()}

    a, b = predicted(table.where("text is not null")), predicted(table.where("text is not null").withColumn("doc_id", -F.col("doc_id")).repartition(1))
    assert a.keys() == b.keys() and len(a) > 500
    assert all(a[k][0] == b[k][0] and abs(a[k][1] - b[k][1]) < 1e-9 for k in a)
    again = LI.train(table.where("doc_id < 1000").repartition(7), 50)
    assert np.array_equal(model.weights, again.weights)


def test_margins_are_sums_over_places(tongues, monkeypatch):
    made, _ = tongues
    monkeypatch.setattr(LI, "STRETCH", 64)
    texts = ["Über-all 9", "a", "", *(t for _, t, _ in made[:20])]
    got = [Counter() for _ in texts]
    for text, cell in LI._grams(pa.array(texts)):
        for i, c in zip(text.tolist(), cell.tolist(), strict=True):
            got[i][c] += 1
    for text, counts in zip(texts, got, strict=True):
        raw = b"   " + bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in text.encode()) + b"   "
        want = Counter()
        for k, n in enumerate(LI.SIZES):
            for i in range(len(raw) - 3):
                gram = raw[i : i + n]
                if gram.strip(b" "):
                    want[(int.from_bytes(gram, "big") * 0x9E3779B1 % 2**32 >> 32 - LI.BITS) + (k << LI.BITS)] += 1
        assert counts == want


def test_few_languages(spark):
    one = spark.createDataFrame([(i, "the thing", "en") for i in range(9)], "doc_id long, text string, lang string")
    assert {(r["lang_pred"], r["score"]) for r in LI.identify(spark, one).collect()} == {("en", 1.0)}
    none = one.withColumn("lang", F.lit(None).cast("string"))
    assert {(r["lang_pred"], r["score"]) for r in LI.identify(spark, none).collect()} == {("und", 0.0)}
    assert LI.identify(spark, one.limit(0)).count() == 0


def test_redact_is_brute_force(spark, monkeypatch):
    """Overlapping, touching and repeated secrets, pieces shorter than secrets, characters beyond the basic plane."""
    monkeypatch.setattr(SS, "CUT", 7)
    rng = random.Random(9)
    parts = ["AKIA" + "B" * 16, "token=" + "0123456789abcdef" * 3, "secret: AKIA" + "C" * 20, "plain 🎉 words", "é\n" * 9, "password=" + "x" * 30, "f" * 40]
    texts = [rng.choice(["", " "]).join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(120)] + [None, "", "AKIA" + "B" * 90]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r["doc_id"]: [tuple(map(int, x.split(":")[1:])) for x in r["spans"].split(",") if x] for r in SS.secret_scan(spark, df).collect()}

    def cleaned(text, found):
        covered = sorted({i for a, b in found for i in range(a, b)})
        starts, at, out = {i for i in covered}, 0, []
        for a, b in sorted(found):
            if a >= at:
                out.append(text[at:a] + "[SECRET]")
            at = max(at, b)
        assert len("".join(out) + text[at:]) >= len(text) - len(starts)
        return "".join(out) + text[at:]

    got = {r["doc_id"]: r["text"] for r in SS.redact(spark, df).collect()}
    assert got == {i: t if not spans[i] else cleaned(t, spans[i]) for i, t in enumerate(texts)}
    assert sum(len(x) > 3 for x in spans.values()) > 30


def test_redact_of_many_secrets_in_one_text(spark):
    """The time follows the length of the text: it copies and scans no text for every secret."""
    text = " ".join(f"word{i} token=abcdefgh{i:06d}" for i in range(100_000))
    began = time.time()
    (row,) = SS.redact(spark, spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert row["text"] == " ".join(f"word{i} [SECRET]" for i in range(100_000))
    assert time.time() - began < 60
