"""Findings of round 3."""

import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import catalog, lexical, posting_lists, vector
from lexmill.plans.queries import ORACLES, QUERIES
from lexmill.session import BATCH_ROWS
from tests.compare import connect, same


@pytest.mark.parametrize("name", ["chunk_code", "chunk_markdown"])
def test_long_turns_stay_whole(spark, tmp_path, name):
    """the SQL has a row for every turn, those over the size of a section too."""
    long = "repeat('some words and more ', 300)"
    duckdb.sql(f"COPY (SELECT * FROM (VALUES (1, 0, 'user', 'short'), (1, 1, 'assistant', {long}), (2, 0, 'user', {long})) t(conv_id, turn, role, text)) TO '{tmp_path}/conversations.parquet'")
    assert same(spark, connect(str(tmp_path)), name, QUERIES[name], ORACLES[name], str(tmp_path)) == ""


def test_partitions_follow_the_postings(spark, monkeypatch):
    """F3 to F7, F11 to F22: a task's share of lists and of matches stays the same when the input grows."""
    assert posting_lists.parts(spark, 0) == 1
    share, direct = posting_lists.SHARE, posting_lists.DIRECT
    assert [posting_lists.parts(spark, n * share) for n in (10, 100, direct, 2 * direct, 4 * direct)] == [10, 100, direct, direct, 2 * direct]
    monkeypatch.setattr(posting_lists, "SHARE", 20)
    docs = spark.createDataFrame([(i, f"w{i % 7} common words of {i}") for i in range(40)], "document_id long, content string")
    lists = posting_lists.lists(posting_lists.counted(docs, T.tokens, "document_id", "content"))
    assert lists.rdd.getNumPartitions() == 10  # of 200 postings
    index = lexical.Index([(lists, None)], spark.range(1), spark.range(1), tokens=200)
    found = lexical.index_matches(index, spark.createDataFrame([("common",), ("w1",)], "term string"))
    assert found.rdd.getNumPartitions() == 10
    assert found.count() == 40 + 6


def test_runs_hold_every_posting(monkeypatch):
    """Runs are cut, gathered over batches and flushed without loss."""
    for name, value in (("RUN", 3), ("PIECE", 5), ("LOT", 8)):
        monkeypatch.setattr(posting_lists, name, value)
    texts = [["a", "b", "a"], [], ["a"] * 9, ["b", "c", "a"], ["a"], ["a", "d"], ["a"], ["e"]]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(i, i + 4)), pa.array(texts[i : i + 4], pa.list_(pa.string()))], ["key", "t"]) for i in (0, 4)]

    def pieces(batch):
        lens = pc.list_value_length(batch.column(1)).to_numpy()
        for _, _, token, row, tf in posting_lists._counts(batch):
            yield token, batch.column(0).take(pa.array(row)), tf, lens[row]

    run, _ = posting_lists._packed("bigint", pieces)
    rows = [r for b in run(iter(batches)) for r in b.to_pylist()]
    assert all(r["n"] == len(r["keys"]) <= 3 and r["first"] == r["keys"][0] for r in rows)
    got = sorted((r["token"], *x) for r in rows for x in zip(r["keys"], r["tfs"], r["lens"], strict=True))
    assert got == sorted((t, i, text.count(t), len(text)) for i, text in enumerate(texts) for t in set(text))


def test_a_packing_worker_holds_little(monkeypatch):
    """F8: what a lot's postings take beside the runs that leave, in numpy and in Arrow, is under 60 bytes each; a batch of runs is small."""
    assert posting_lists.RUN * BATCH_ROWS <= 1 << 19
    monkeypatch.setattr(posting_lists, "LOT", 1 << 18)
    rng, n = np.random.default_rng(0), 1 << 16
    batches = [pa.record_batch([pa.array([i], pa.int64())], ["i"]) for i in range(8)]

    def pieces(batch):
        yield pa.array(rng.integers(0, 1 << 15, n).astype(str)), pa.array(np.arange(n)), np.ones(n, dtype=np.int64), np.ones(n, dtype=np.int32)

    run, _ = posting_lists._packed("bigint", pieces)
    pool = pa.system_memory_pool()
    default = pa.default_memory_pool()
    pa.set_memory_pool(pool)
    tracemalloc.start()
    most = rows = 0
    try:
        for b in run(iter(batches)):
            most, rows = max(most, tracemalloc.get_traced_memory()[0] + pool.bytes_allocated()), rows + pc.sum(b.column(2)).as_py()
    finally:
        tracemalloc.stop()
        pa.set_memory_pool(default)
    assert rows == 8 * n
    assert most < 60 * posting_lists.LOT, most / posting_lists.LOT


def test_a_share_is_full_at_a_tenth_of_a_gigabyte(spark):
    """F13 to F21: 0.1 GB of texts has 28 million tokens; a task's share of them is the same at 1 GB, and at 6 GB its exchange still has
    so few parts that the tasks before it hold no rows."""
    n = [posting_lists.parts(spark, tokens, posting_lists.GROWN) for tokens in (28_000_000, 280_000_000, 1_680_000_000)]
    assert n == [19, 187, posting_lists.DIRECT]


def test_refreshed_postings_are_neither_sorted_nor_counted_by_an_exchange(spark):
    """a document's counts are made in its task and go through the joins in one row, unsorted."""
    docs = spark.createDataFrame([(f"p{i}", str(i % 9), "the words the " * (i % 3) + f"x{i}") for i in range(20)], "path string, checksum string, content string")
    old = docs.where("path <> 'p3'").withColumn("checksum", F.when(F.col("path") == "p4", "-").otherwise(F.col("checksum")))
    bags = lambda x: posting_lists.bags(x, T.tokens, "path", "content")
    assert "Exchange" not in bags(docs)._jdf.queryExecution().executedPlan().toString()
    got = catalog.refresh_postings(bags(old), catalog.index_diff(docs, old), docs, bags)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ShuffledHashJoin") == 2 and "LeftAnti" in plan
    rows = posting_lists.unbagged(got).select("path", "token", "tf")
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, lexical.postings(docs, key="path").select("path", "token", "tf").collect()))


def test_a_product_of_blocks_takes_little_memory():
    """what a worker holds for a pair of blocks is bounded, whatever the number of vectors and queries."""
    rng = np.random.default_rng(0)
    x, q = rng.standard_normal((vector.BLOCK, 64)), rng.standard_normal((vector.QUERIES, 64))
    step = max(1, vector.CELLS // len(x))
    tracemalloc.start()
    for a in range(0, len(q), step):
        vector._nearest(q[a : a + step], x, np.arange(len(x)), 10, "cosine")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20
