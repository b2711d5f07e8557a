"""The durable index: pruned lists, versions, segments, tombstones, compaction."""

import os
import random

import pytest
from pyspark.sql import functions as F

from lexmill.operators import lexical, posting_lists
from lexmill.sources.index_store import Conflict, IndexStore

SCHEMA = "document_id long, collection_id string, path string, title string, content string"


def made(spark, ids, say=lambda i: "the cat " + "sat on the mat " * (i % 4) + f"running {i} é{i % 3}"):
    return spark.createDataFrame([(i, f"c{i % 2}", f"p/{i}.md", f"t{i}", say(i)) for i in ids], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(0, "the ca"), (1, "mat"), (2, "nothing"), (3, ""), (4, "run 1"), (5, "c"), (6, "ca cat"), (7, "é1 r"), (8, "THE ca"), (9, None)], "query_id long, query string")


def searched(spark, asked, docs=None, index=None, **how):
    return sorted(map(str, lexical.bm25_search(docs, asked, index=index, **how).collect()))


@pytest.mark.parametrize("most", [posting_lists.TERMS, 3])
def test_an_index_finds_what_texts_give(spark, asked, tmp_path, monkeypatch, most):
    monkeypatch.setattr(posting_lists, "TERMS", most)  # beyond it terms stay a table
    monkeypatch.setattr(posting_lists, "RANGES", 2)
    monkeypatch.setattr(posting_lists, "LIST", 4)
    docs = made(spark, range(30)).unionByName(spark.createDataFrame([(99, "c0", "p/99.md", "t", None), (98, "c1", "p/98.md", None, "")], SCHEMA))
    store = IndexStore(spark, f"file://{tmp_path}/i")
    store.write(docs)
    some = spark.createDataFrame([("c1",)], "collection_id string")
    for how in ({}, {"limit": 3, "offset": 2}, {"collections": some}, {"stems": False}):
        one, two = searched(spark, asked, docs, **how), searched(spark, asked, None, store.index(), **how)
        assert one == two and len(one) > 5
    flat = {(r["document_id"], r["token"]): (r["tf"], r["len"]) for r in store.index().postings.collect()}
    lengths = {r["document_id"]: r["len"] for r in lexical.doc_lengths(docs).collect()}
    assert flat == {(r["document_id"], r["token"]): (r["tf"], lengths[r["document_id"]]) for r in lexical.postings(docs).collect()}
    assert store.index().stats.first()["n_docs"] == 32 and store.index().facts.count() == 32


def test_ranges_hold_all_that_begins_with_a_head(monkeypatch):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("ab퟿z\U0010ffff" if rng.random() < 0.3 else "abz") for _ in range(rng.randrange(1, 5)))
    for _ in range(300):
        head = word()
        below = posting_lists.successor(head)
        for w in (word() for _ in range(20)):
            inside = w >= head and (below is None or w < below)
            assert inside == w.startswith(head)
    assert posting_lists.successor("\U0010ffff") is None and posting_lists.successor("a퟿") == "a"


def test_a_scan_reads_the_ranges_of_its_terms(spark, tmp_path):
    """Row groups without a matching token are not read, and the plan shows the literal ranges."""
    store = IndexStore(spark, f"file://{tmp_path}/i")
    store.write(spark.createDataFrame([(i, " ".join(f"w{(i * 37 + j) % 9000:05d}" for j in range(300))) for i in range(600)], "document_id long, content string").repartition(2))
    one = spark.createDataFrame([(0, "w00042")], "query_id long, query string")
    found = lexical.bm25(None, one, index=store.index(), stems=False)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(token,w00042)" in plan and "LessThan(token,w00043)" in plan

    def scanned(p):
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return scanned(p.executedPlan())
        if name.endswith("QueryStageExec"):
            return scanned(p.plan())
        own = p.metrics().apply("numOutputRows").value() if name == "FileSourceScanExec" and "token" in p.schema().simpleString() else 0
        return max([own, *(scanned(p.children().apply(i)) for i in range(p.children().size()))])

    def read(df):
        df.collect()
        return scanned(df._jdf.queryExecution().executedPlan())

    every = read(store.index().segments[0][0].select("token", "docs"))
    assert every > 9000 and 0 < read(found) < every / 2


def test_updates_and_deletes_score_as_a_rebuild(spark, asked, tmp_path):
    path = f"file://{tmp_path}/i"
    IndexStore(spark, path).write(made(spark, range(40)))
    say = lambda i: f"the new cat mat {i} " * 2
    state = {i: made for i in range(40)}
    changes = [(range(5, 12), None, say), (None, [3, 5, 6, 777], None), (range(38, 45), [0, 1], lambda i: "ca " * i), (range(0, 2), None, say), (None, range(20, 60), None)]
    texts = {r["document_id"]: r["content"] for r in made(spark, range(40)).collect()}
    written = []
    for put, gone, text in changes:
        for i in gone or ():
            texts.pop(i, None)
        for i in put or ():
            texts[i] = text(i)
        store = IndexStore(spark, path)  # opened anew each time
        before = size(tmp_path)
        store.write(None if put is None else made(spark, put, text), None if gone is None else spark.createDataFrame([(i,) for i in gone], "document_id long"))
        written.append(size(tmp_path) - before)
        rebuilt = made(spark, sorted(texts), texts.get)
        index = store.index()
        assert searched(spark, asked, None, index, limit=50) == searched(spark, asked, rebuilt, limit=50)
        assert tuple(index.stats.first()) == tuple(lexical.corpus_stats(lexical.doc_lengths(rebuilt)).first())
        assert sorted(map(tuple, index.vocabulary.select("token", "df", "cf").collect())) == sorted(map(tuple, lexical.term_df(lexical.postings(rebuilt)).collect()))
    state = store.manifest()
    assert state["version"] == 6 and len(state["segments"]) > 1
    old = store.index(1)
    assert old.facts.count() == 40, "an old version stays readable"
    store.compact()
    assert len(store.manifest()["segments"]) == 1 and not store.manifest()["segments"][0]["dead"]
    assert searched(spark, asked, None, store.index(), limit=50) == searched(spark, asked, made(spark, sorted(texts), texts.get), limit=50)
    assert store.vacuum(keep=1) and store.versions() == [7]
    assert searched(spark, asked, None, IndexStore(spark, path).index(), limit=50) == searched(spark, asked, made(spark, sorted(texts), texts.get), limit=50)


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names)


def test_writes_follow_the_change_and_many_segments_merge(spark, asked, tmp_path):
    store = IndexStore(spark, f"file://{tmp_path}/i")
    store.write(made(spark, range(3000), lambda i: " ".join(f"w{i * j}" for j in range(60))))
    whole = size(tmp_path)
    store.write(made(spark, [5], lambda i: "one small change"))
    assert size(tmp_path) - whole < whole / 10
    for i in range(4):
        store.write(made(spark, [10_000 + i]), most_segments=3)
    assert len(store.manifest()["segments"]) <= 3
    assert store.index().facts.count() == 3004 and store.index().stats.first()["n_docs"] == 3004


def test_one_of_two_writers_fails_and_a_failed_write_changes_nothing(spark, asked, tmp_path):
    path = f"file://{tmp_path}/i"
    one, two = IndexStore(spark, path), IndexStore(spark, path)
    base = one.write(made(spark, range(5)))
    before = searched(spark, asked, None, two.index())
    one.write(deletes=made(spark, [1]), base=base)
    with pytest.raises(Conflict):
        two.write(made(spark, [9]), base=base)
    assert two.versions() == [1, 2] and searched(spark, asked, None, two.index(1)) == before
    broken = made(spark, [7]).withColumn("content", F.raise_error(F.lit("no disk")).cast("string"))
    now = searched(spark, asked, None, one.index())
    with pytest.raises(Exception, match="no disk"):
        one.write(broken)
    assert one.versions() == [1, 2] and searched(spark, asked, None, one.index()) == now
    for bad in (made(spark, [7, 7]), made(spark, [7]).withColumn("document_id", F.lit(None).cast("long"))):
        with pytest.raises(ValueError, match="null or comes twice"):
            one.write(bad)
    assert one.versions() == [1, 2]


def test_an_index_of_nothing(spark, tmp_path):
    store = IndexStore(spark, f"{tmp_path}/i")  # without a scheme
    with pytest.raises(ValueError, match="no documents"):
        store.index()
    store.write(made(spark, [1, 2]))
    store.write(deletes=made(spark, [1, 2, 3]))
    with pytest.raises(ValueError, match="no documents"):
        store.index()
    store.write(made(spark, [1]).limit(0))
    store.write(made(spark, [4]))
    assert [r["document_id"] for r in store.index().facts.collect()] == [4]
    for text in ("", "...", None):
        nothing = spark.createDataFrame([(0, text)], "query_id long, query string")
        assert lexical.bm25_search(None, nothing, index=store.index()).count() == 0
    assert lexical.bm25_search(None, nothing.limit(0), index=store.index()).count() == 0
