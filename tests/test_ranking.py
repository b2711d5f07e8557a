"""Snippets, pair scorers, rerank texts and context assembly against plain Python."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.operators import catalog, fusion, scoring, snippets
from lexmill.plans import search as S


def window(text, terms, most):
    text = text or ""
    cut = lambda t: t if len(t) <= most else t[: most - 3] + "..."
    parts = [s.strip(" ") for s in re.split(r"(?<=[.!?])\s+", text) if s.strip(" ")]
    scores = [sum(s.lower().count(t.lower()) * len(t) for t in terms or () if t) for s in parts]
    if len(parts) <= 1 or max(scores) == 0:
        return cut(text)
    lo = hi = scores.index(max(scores))
    size, grew = len(parts[lo]), True
    while grew:
        grew = False
        if lo and size + len(parts[lo - 1]) + 1 <= most:
            lo, size, grew = lo - 1, size + len(parts[lo - 1]) + 1, True
        if hi + 1 < len(parts) and size + len(parts[hi + 1]) + 1 <= most:
            hi, size, grew = hi + 1, size + len(parts[hi + 1]) + 1, True
    return ("..." if lo else "") + cut(" ".join(parts[lo : hi + 1])) + ("..." if hi + 1 < len(parts) else "")


@pytest.mark.parametrize("most", [30, 100, 300])
def test_snippets_are_the_window(spark, most):
    rng = random.Random(1)
    word = lambda: rng.choice(["cat", "Cats", "dog", "é", "running", "a", "mat"])
    texts = ["".join(" ".join(word() for _ in range(rng.randrange(1, 12))) + rng.choice([". ", "! ", "?\n", ".  ", ", "]) for _ in range(rng.randrange(1, 30))) for _ in range(150)]
    rows = [(i, t, rng.choice([["cat"], ["DOG", "mat"], ["zzz"], [], None, ["", None, "é"], ["at"]])) for i, t in enumerate([*texts, None, "", "short", "word " * 200, "First one here. The cat sat. Last."])]
    found = spark.createDataFrame(rows, "i long, t string, w array<string>").select("i", snippets.snippets(F.col("t"), F.col("w"), most).alias("s"))
    assert {r["i"]: r["s"] for r in found.collect()} == {i: window(t, w, most) for i, t, w in rows}


def test_a_long_text_has_a_snippet(spark):
    text = "plain words here. " * 20_000 + "one needle stands here. " + "more words. " * 20_000
    (row,) = spark.createDataFrame([(text, ["needle"])], "t string, w array<string>").select(snippets.snippets(F.col("t"), F.col("w"), 60).alias("s")).collect()
    assert row["s"] == window(text, ["needle"], 60) and "needle" in row["s"]


class Tiny:
    """A causal model of one layer in numpy: logits of the last place from a mean of embeddings."""

    def __init__(self):
        rng = np.random.default_rng(5)
        self.table, self.head = rng.normal(size=(64, 8)), rng.normal(size=(8, 2))
        self.shapes = []

    def tokenize(self, text):
        return [sum(map(ord, w)) % 64 for w in text.split()]

    def logits(self, batch):
        wide = max(map(len, batch))
        self.shapes.append((len(batch), wide))
        mask = np.array([[1.0] * len(x) + [0.0] * (wide - len(x)) for x in batch])
        ids = np.array([x + [0] * (wide - len(x)) for x in batch])
        return ((self.table[ids] * mask[:, :, None]).sum(axis=1) / mask.sum(axis=1, keepdims=True)) @ self.head


def test_causal_scores_are_brute_force(spark):
    rng, model = random.Random(3), Tiny()
    text = lambda n: " ".join(rng.choice("one two three four five".split()) for _ in range(rng.randrange(n)))
    pairs = [(text(5), text(200)) for _ in range(300)] + [(None, "x"), ("x", None), ("", "")]
    scorer = scoring.CausalScorer(model.tokenize, model.logits)
    whole = [(f"<Instruct>: {scoring.INSTRUCTION}\n<Query>: {q or ''}\n<Document>: {t or ''}") for q, t in pairs]
    want = []
    for prompt in whole:
        no, yes = model.logits([model.tokenize(prompt)[:90]])[0]
        want.append(np.exp(yes) / (np.exp(yes) + np.exp(no)))
    model.shapes.clear()
    got = scoring.scored(scorer, pairs, 1000, 90)
    assert np.allclose(1 / (1 + np.exp(-np.array(got))), want)
    assert all(n * w <= 1000 for n, w in model.shapes) and len(model.shapes) < len(pairs) / 5

    def factory():
        m = Tiny()
        return scoring.CausalScorer(m.tokenize, m.logits)

    rows = spark.createDataFrame([(i, q, t) for i, (q, t) in enumerate(pairs)], "i long, q string, t string").repartition(3)
    out = rows.select("i", fusion.sigmoid(scoring.pair_scores(factory, 1000, 90)(F.col("q"), F.col("t"))).alias("p")).collect()
    assert np.allclose([r["p"] for r in sorted(out)], want)


def test_batches_and_bad_scorers():
    assert list(scoring.batches([], 10)) == []
    assert list(scoring.batches([5, 1, 50, 2, 5], 10)) == [[1, 3], [0, 4], [2]]
    with pytest.raises(ValueError, match="2 scores for 1"):
        scoring.scored(scoring.CausalScorer(lambda t: [1], lambda b: [(0, 1)] * 2), [("a", "b")], 10, 10)


def test_rerankers_by_name_and_type():
    every = {"causal": 1, "bi": 2, "cross": 3}
    for name, kind, want in (("Qwen/Qwen3-Reranker-0.6B", "gguf", 1), ("my_qwen3_reranker", "sentence_transformers", 1), ("x.gguf", "gguf", 2), ("any", "sentence_transformers", 3), ("sentence_transformers/x", "gguf", 2)):
        assert fusion.create_reranker(name, every, kind) == want
    with pytest.raises(ValueError, match="type"):
        fusion.create_reranker("x", every, "onnx")
    with pytest.raises(ValueError, match="no causal"):
        fusion.create_reranker("qwen3-reranker", {"bi": 1})


def test_rerank_text_of_empty_parts(spark):
    rows = [(t, c, h) for t in ("T", "", None) for c in ("C", "", None) for h in ("H", "", None)]
    got = spark.createDataFrame(rows, "t string, c string, h string").select(fusion.rerank_text(F.col("t"), F.col("c"), F.col("h")).alias("x")).collect()
    for (t, c, h), r in zip(rows, got, strict=True):
        text = c or h or ""
        assert r["x"] == (f"{t}\n\n{text}" if t and text else t or text)


def test_search_reranks_by_highlight_without_content(spark):
    docs = spark.createDataFrame([(1, "c", "a.md", "", "the cat sat"), (2, "c", "b.md", "", "the cat ran")], "document_id long, collection_id string, path string, title string, content string")
    chunks = docs.select("document_id", F.lit(0).alias("sequence"), "content")
    bare = docs.withColumn("content", F.when(F.col("document_id") == 1, F.col("content")).otherwise(""))
    q = spark.createDataFrame([(0, "lex: cat")], "query_id long, query string")
    from lexmill.operators import lexical

    found = lexical.bm25_search(docs, q.withColumn("query", F.lit("cat"))).select("query_id", "document_id")
    assert found.count() == 2
    out = S.search(spark, docs, q, reranker=lambda query, text: F.length(text).cast("double"), chunks=chunks)
    assert out.count() == 2
    marked = lexical.highlights(chunks, found, lexical.query_terms(spark.createDataFrame([(0, "cat")], "query_id long, query string")), most=1)
    rows = bare.join(marked, "document_id").select("document_id", fusion.rerank_text(F.col("title"), bare["content"], F.col("highlight")).alias("x"))
    assert {r["document_id"]: r["x"] for r in rows.collect()} == {1: "the cat sat", 2: "the cat ran"}


def test_context_assembly(spark):
    rows = [("g2", "z", "global", "all z"), ("g1", "a", "global", "all a"), ("c1", "docs", "collection", "of docs"), ("c2", "notes", "collection", "of notes"), ("p1", "/a/b/x.md", "path", "x"), ("p2", "/a/c.md", "path", "c"), ("p3", "/a/b", "path", "b"), ("p4", "/b/a", "path", "ba")]
    contexts = spark.createDataFrame(rows, "context_id string, target_id string, context_type string, content string").repartition(3)
    asked = [(0, ["notes", "none", "docs"], ["/a/b", "/a/b/"]), (1, [], None), (2, None, [""]), (3, ["docs", "docs"], ["/c", "/b", "/a/c.md and more"])]
    table = spark.createDataFrame(asked, "query_id long, collection_ids array<string>, path_prefixes array<string>")
    want = {}
    for i, ids, prefixes in asked:
        parts = ["all a", "all z"] + [r[3] for c in ids or [] for r in rows if r[2] == "collection" and r[1] == c]
        parts += [r[3] for r in sorted(rows, key=lambda r: r[1]) if r[2] == "path" and any(r[1].startswith(p) for p in prefixes or [])]
        want[i] = "\n\n".join(parts)
    assert {r["query_id"]: r["text"] for r in catalog.build_context(contexts, table).collect()} == want
    assert [r["text"] for r in catalog.build_context(contexts.limit(0), table).collect()] == [""] * 4
