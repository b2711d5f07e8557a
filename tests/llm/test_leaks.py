"""Short answers, scripts without spaces and repeated items in decontamination."""

import random

import pyarrow as pa

from lexmill.llm import decontaminate as DC

MARS = "How many moons does the planet Mars have in total ?"


def found(items, texts):
    return {(d, i) for d, i, *_ in DC.search(DC.build_index(items), pa.array(texts))}


def test_short_answers_stand_beside_their_question():
    items = [(1, MARS + " Two"), (2, "Which red dye did the old weavers of the valley prefer ? madder root"), (3, "Name the capital of the northern province of our island ? ..."), (4, "? Two moons circle the planet Mars in total as we know")]
    texts = [
        "we asked how many moons does the planet mars have in total and nobody knew",
        "we asked how many moons does the planet mars have in total ... it has two of them",
        "Which red dye did the old weavers of the valley prefer? It was madder root.",
        "Which red dye did the old weavers of the valley prefer? The root of some madder.",
        "name the capital of the northern province of our island",
        "as two moons circle the planet Mars in total as we know",
    ]
    assert found(items, texts) == {(1, 1), (2, 2), (4, 3), (5, 4)}
    assert DC.question_answer(MARS + " Two") == (MARS, " Two")


def test_scripts_without_spaces():
    han, thai = "火星一共有多少颗卫星在围绕它运行答案是两颗", "ดาวอังคารมีดวงจันทร์บริวารกี่ดวงคำตอบคือสองดวง"
    texts = ["前面的文字很长很长" + han + "后面还有别的句子和说明", "ข้อความอื่น" + thai + "ข้อความอื่น", "前面的文字很长很长", "火星卫星", "plain words only"]
    assert found([(1, han), (2, thai)], texts) == {(0, 1), (1, 2)}
    assert [len(h) for h in DC._hashes(["ab 火星cd", "naïve café", "ĀāЖж x"])] == [4, 2, 2]


def test_short_answers_by_brute_force():
    """All item-text pairs: a text has an item's question 3-grams and its one- or two-word answer as a phrase, or it is no hit."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "ren"]) for _ in range(rng.randrange(1, 4)))
    items = [(i, [word() for _ in range(rng.randrange(9, 16))], [word() + str(i) for _ in range(rng.randrange(1, 3))]) for i in range(40)]
    texts = []
    for _, q, a in items:
        texts += [[*q, *a], [*q, "nobody", "knew"], [*q, *reversed(a)], [word(), *a, *q, word()], a]
    got = found([(i, " ".join(q) + " ? " + " ".join(a)) for i, q, a in items], [" ".join(t) for t in texts])
    want = set()
    for d, t in enumerate(texts):
        grams = {tuple(t[k : k + 3]) for k in range(len(t))}
        for i, q, a in items:
            own = {tuple(q[k : k + 3]) for k in range(len(q) - 2)}
            if len(own & grams) >= DC.OVERLAP * len(own) and any(t[k : k + len(a)] == a for k in range(len(t))):
                want.add((d, i))
    assert got == want and len(want) > 80


def test_repeated_items_are_indexed_once(spark, monkeypatch):
    """Thousands of equal items fill no broadcast, and every id of theirs is reported."""
    monkeypatch.setattr(DC, "SHARD_WORDS", 300)
    text = "a benchmark item that someone has copied far too often by mistake"
    bench = spark.createDataFrame([(i, text) for i in range(3000)] + [(5, text), (7, "another item of that id with its own nine words")], "item_id long, text string").repartition(3)
    docs = spark.createDataFrame([(1, "x " + text + " y"), (2, "another item of that id with its own nine words"), (1, text)], "doc_id long, text string")
    items, names = DC._items(spark, bench)
    assert items.count() == 2 and names.count() == 3001
    got = [(r["doc_id"], r["item_id"]) for r in DC.contamination(spark, docs, bench).collect()]
    assert sorted(got) == sorted([(1, i) for i in range(3000)] * 2 + [(2, 7)])
    assert DC.decontaminate(spark, docs, bench).count() == 0
