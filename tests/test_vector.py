"""Block k-NN and whole-text search against brute force."""

import random

import numpy as np
import pytest

from lexmill.operators import lexical, vector


def table(spark, rows, name="embedding_id"):
    return spark.createDataFrame(rows, f"{name} long, document_id long, embedding array<float>").repartition(4)


def brute(rows, queries, k, metric):
    out = set()
    for qid, _, q in queries:
        q = np.array(q, dtype=np.float32).astype(float)
        each = []
        for i, doc, v in rows:
            if v is not None:
                v = np.array(v, dtype=np.float32).astype(float)
                d = np.sqrt(((v - q) ** 2).sum()) if metric == "l2" else 1 - v @ q / (np.sqrt(v @ v) * np.sqrt(q @ q) + 1e-8)
                each.append((round(float(d), 9), i, doc))
        out |= {(qid, i, doc, n + 1) for n, (_, i, doc) in enumerate(sorted(each)[:k])}
    return out


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("block", [4096, 7])
def test_knn_is_brute_force(spark, monkeypatch, metric, block):
    """Ties by id, equal and zero and null vectors, blocks smaller and larger than k; more queries than a block make no other plan."""
    monkeypatch.setattr(vector, "BLOCK", block)
    monkeypatch.setattr(vector, "QUERIES", 5)
    monkeypatch.setattr(vector, "CELLS", 40)
    rng = random.Random(2)
    v = lambda: [rng.choice([-1.0, 0.0, 0.5, 1.0, rng.random()]) for _ in range(4)]
    rows = [(i, i // 2, v()) for i in range(90)] + [(100 + i, 50, [0.3, 0.1, 0.7, 0.2]) for i in range(40)] + [(200, 1, [0.0] * 4), (201, 1, None)]
    queries = [(i, 0, v()) for i in range(12)] + [(50, 0, [0.3, 0.1, 0.7, 0.2]), (51, 0, [0.0] * 4)]
    found = vector.knn(table(spark, rows), table(spark, queries, "query_id"), 10, metric, min_score=None)
    got = {(r["query_id"], r["embedding_id"], r["document_id"], r["rank"]) for r in found.collect()}
    assert got == brute(rows, queries, 10, metric)


def test_knn_edges(spark):
    rows = table(spark, [(1, 1, [1.0, 0.0]), (2, 2, [0.0, 1.0])])
    none = rows.limit(0)
    q = rows.withColumnRenamed("embedding_id", "query_id")
    assert vector.knn(none, q).count() == 0 and vector.knn(rows, q.limit(0)).count() == 0
    with pytest.raises(Exception, match="dimension mismatch"):
        vector.knn(rows, table(spark, [(1, 1, [1.0])], "query_id")).collect()
    with pytest.raises(Exception, match="dimension mismatch"):
        vector.knn(table(spark, [(1, 1, [1.0]), (2, 1, [1.0, 2.0])]).coalesce(1), q).collect()
    with pytest.raises(ValueError, match="metric"):
        vector.knn(rows, q, metric="dot")
    named = spark.createDataFrame([("b", "x", [1.0, 0.0]), ("a", "y", [1.0, 0.0])], "embedding_id string, document_id string, embedding array<double>")
    assert [r["embedding_id"] for r in vector.knn(named, q.where("query_id = 1"), 1).collect()] == ["a"]


def test_precision_of_near_equal_vectors(spark):
    """Vectors that differ by less than a product's rounding are ranked by their own distances."""
    base = [1000.0 + i for i in range(16)]
    rows = [(i, i, [*base[:-1], base[-1] + i * 2.0**-9]) for i in range(60)]
    q = [(0, 0, base)]
    got = {(r["query_id"], r["embedding_id"], r["document_id"], r["rank"]) for r in vector.knn(table(spark, rows), table(spark, q, "query_id"), 5, min_score=None).collect()}
    assert got == brute(rows, q, 5, "l2") == {(0, i, i, i + 1) for i in range(5)}


def test_doubles_stay_doubles(spark):
    rows = spark.createDataFrame([(i, i, [1.0 + i * 1e-9, 2.0]) for i in range(9)], "embedding_id long, document_id long, embedding array<double>").repartition(2)
    q = spark.createDataFrame([(0, [1.0 + 8e-9, 2.0])], "query_id long, embedding array<double>")
    assert [r["embedding_id"] for r in vector.knn(rows, q, 3).orderBy("rank").collect()] == [8, 7, 6]


def test_holding(spark):
    texts = ["one two three four five six", "three four five", "two three", "a  b, c", "x", "", None, "THREE four"]
    items = [(0, "two three four five"), (1, "wo three fou"), (2, "thr"), (3, "e t"), (4, "b, c"), (5, None), (6, "five six seven eight"), (7, "  b, c"), (8, "ne two three four five si")]
    docs = spark.createDataFrame(list(enumerate(texts)), "document_id long, content string").repartition(3)
    found = lexical.holding(docs, spark.createDataFrame(items, "query_id long, text string"))
    assert sorted(map(tuple, found.collect())) == sorted((q, d) for q, i in items for d, t in enumerate(texts) if i is not None and t is not None and i in t)
    assert lexical.holding(docs, spark.createDataFrame([], "query_id long, text string")).count() == 0
