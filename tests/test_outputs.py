"""Whole outputs, cleanup as one job, collections with paths, files as a last resort, limits of options."""

import csv
import io
import json
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from lexmill.operators import catalog
from lexmill.plans import search as S
from lexmill.sources import sinks

COLS = ["rank", "document_id", "title", "path", "score"]


@pytest.fixture(scope="module")
def results(spark):
    rows = [(0, 2, "b", 'a "quoted", title', "p/b,c.md", 0.5), (0, 1, "a", "x < y & z | w", "p/ü.md", None), (1, 1, "c", None, "p/c.md", 1.25), (0, 3, "d", "two\nlines", "p/d.md", 2.0)]
    return spark.createDataFrame(rows, "query_id long, rank long, document_id string, title string, path string, score double").repartition(3), rows


def documents(results, kind):
    return {r["query_id"]: r["document"] for r in sinks.result_documents(results[0], kind, COLS, title="Found").collect()}


def test_json_and_csv_read_back(results):
    ordered = {q: sorted(r for r in results[1] if r[0] == q) for q in (0, 1)}
    for q, text in documents(results, "json").items():
        assert json.loads(text) == [dict(zip(COLS, r[1:], strict=True)) for r in ordered[q]]
        assert text == json.dumps(json.loads(text), indent=2, ensure_ascii=False)
    for q, text in documents(results, "csv").items():
        want = io.StringIO()
        writer = csv.writer(want)
        writer.writerows([COLS, *[["" if x is None else x for x in r[1:]] for r in ordered[q]]])
        assert text == want.getvalue()


def test_tables_xml_and_files(results):
    md = documents(results, "md")
    assert md[0].split("\n")[:5] == ["## Found", "", "| rank | document_id | title | path | score |", "| --- | --- | --- | --- | --- |", "| 1 | a | x < y & z \\| w | p/ü.md |  |"]
    assert md[0].endswith("| 3 | d | two lines | p/d.md | 2.0 |") and len(md[0].split("\n")) == 7
    tree = ET.fromstring(documents(results, "xml")[0])
    assert [[x.text or "" for x in item] for item in tree] == [["1", "a", "x < y & z | w", "p/ü.md", ""], ["2", "b", 'a "quoted", title', "p/b,c.md", "0.5"], ["3", "d", "two\nlines", "p/d.md", "2.0"]]
    assert documents(results, "files") == {0: "p/ü.md\np/b,c.md\np/d.md", 1: "p/c.md"}
    with pytest.raises(ValueError, match="format"):
        sinks.result_documents(results[0], "yaml", COLS)
    assert sinks.result_documents(results[0].limit(0), "json", COLS).count() == 0


def test_cleanup_is_one_job(spark):
    now = F.to_timestamp(F.lit("2024-01-02"))
    tables = {
        "documents": spark.createDataFrame([(1,), (2,)], "document_id long"),
        "chunks": spark.createDataFrame([(1, "a"), (3, "b"), (None, "c")], "document_id long, content string"),
        "embeddings": spark.createDataFrame([(9, "e")], "document_id long, content string"),
        "llm_cache": spark.sql("SELECT * FROM VALUES (1, TIMESTAMP '2024-01-01'), (2, TIMESTAMP '2024-01-02'), (3, NULL), (4, TIMESTAMP '2024-01-03') AS t(id, expires_at)"),
    }
    out, report = catalog.cleanup(tables, now)
    assert report.first().asDict() == {"chunks_removed": 2, "embeddings_removed": 1, "llm_cache_removed": 2}
    assert [out[t].count() for t in ("documents", "chunks", "embeddings", "llm_cache")] == [2, 1, 0, 2]
    again = catalog.cleanup(out, now)[1].first().asDict()
    assert set(again.values()) == {0}


def test_collections_with_paths(spark):
    old = spark.createDataFrame([("1", "docs", ["/a", "/b"]), ("2", "empty", None)], "collection_id string, name string, paths array<string>")
    paths = lambda df: {r["name"]: r["paths"] for r in df.collect()}
    assert paths(catalog.change_paths(old, "docs", ["/c", "/a"], ["/b"])) == {"docs": ["/a", "/c"], "empty": None}
    assert paths(catalog.change_paths(old, "empty", ["/x"]))["empty"] == ["/x"] and paths(catalog.change_paths(old, "docs", remove=["/a", "/b"]))["docs"] == []
    for name, gone in (("docs", ["/z"]), ("nope", [])):
        with pytest.raises(ValueError):
            catalog.change_paths(old, name, remove=gone)
    tables = {"collections": old, "documents": spark.createDataFrame([(1, "1", 5), (2, "1", 6), (3, "2", 7)], "document_id long, collection_id string, file_size long"), "chunks": spark.createDataFrame([(1,), (1,), (3,)], "document_id long")}
    row = catalog.show_collection(tables, "docs").first()
    assert (row["n_documents"], row["n_bytes"], row["n_chunks"]) == (2, 11, 2)
    with pytest.raises(ValueError):
        catalog.show_collection(tables, "nope")
    wanted = spark.createDataFrame([(1,), (8,), (1,)], "document_id long")
    assert sorted(map(tuple, catalog.existing(tables["documents"], wanted).collect())) == [(1, True), (8, False)]


def test_a_file_is_the_last_resort(spark, tmp_path):
    docs = spark.createDataFrame([(1, "p/a.md", "a.md", "one\ntwo")], "document_id long, path string, filename string, content string")
    place = tmp_path / "outside.md"
    place.write_text("first\nsecond\nthird\n")
    assert [r["content"] for r in S.call_get(spark, docs, "a.md", 2).collect()] == ["two"]
    assert [r["content"] for r in S.call_get(spark, docs, f"file://{place}", 2, 1).collect()] == ["second"]
    for none in ("nothing", f"file://{tmp_path}/none.md", f"file://{tmp_path}", "odd://x:y z"):
        assert S.call_get(spark, docs, none).count() == 0


def test_limits_of_options():
    S.SearchOptions(k1=0.1, b=1.0, rerank_top_k=1)
    for bad in ({"k1": 3.5}, {"k1": 0.0}, {"b": 1.5}, {"b": 0.0}, {"rerank_top_k": 0}, {"rerank_top_k": 101}, {"offset": -1}):
        with pytest.raises(ValueError, match=next(iter(bad))):
            S.SearchOptions(**bad)


@pytest.mark.parametrize("few", [100_000, 4])
def test_byte_budget_is_the_fold(spark, monkeypatch, few):
    """Large groups in rounds over ranges, small ones folded: documents that fit, in order, whatever lies between."""
    import random

    monkeypatch.setattr(catalog, "FOLD", few)
    rng = random.Random(7)
    rows = [(i, f"g{min(4, int(rng.expovariate(0.8)))}", rng.choice([None, 0, 1, 7, 30, 90, 99, 100, 101, 5000])) for i in range(300)]
    docs = spark.createDataFrame(rows, "document_id long, collection_id string, file_size long").repartition(5)
    want, left = set(), {}
    for i, g, n in rows:
        if (n or 0) <= left.setdefault(g, 1000):
            left[g] -= n or 0
            want.add(i)
    assert {r["document_id"] for r in catalog.byte_budget(docs, 1000).collect()} == want
    assert catalog.byte_budget(docs.limit(0), 1000).count() == 0 and {r["file_size"] for r in catalog.byte_budget(docs, 0).collect()} <= {None, 0}
