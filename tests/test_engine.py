"""Operators on small tables, against plain Python or known values."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from lexmill.functions import porter
from lexmill.functions import text as T
from lexmill.functions import vectors as V
from lexmill.operators import catalog, chunking, evaluation, fusion, lexical, snippets, vector
from lexmill.plans import search as S
from lexmill.sources import files, sinks
from lexmill.streaming import watch

TEXTS = [(1, "alpha beta alpha"), (2, "alphabet soup and beta"), (3, ""), (4, "running runner runs"), (5, "beta beta gamma"), (6, "beta beta gamma")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, "c" + str(i % 2), f"d/{i}.md", f"{i}.md", f"t{i}", t, len(t)) for i, t in TEXTS]
    return spark.createDataFrame(rows, "document_id long, collection_id string, path string, filename string, title string, content string, file_size long")


def queries(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")


def test_bm25_against_fts5(spark, docs):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(content, tokenize=\"unicode61 remove_diacritics 0\")")
    con.executemany("INSERT INTO f(rowid, content) VALUES (?, ?)", TEXTS)
    for q in ("alpha", "beta gam", "beta beta", "run"):
        match = " AND ".join(f"{t}*" for t in q.split())
        want = {r: -s for r, s in con.execute("SELECT rowid, rank FROM f WHERE f MATCH ?", (match,))}
        got = {r["document_id"]: r["bm25"] for r in lexical.bm25(docs, queries(spark, q)).collect()}
        assert got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_porter_against_fts5(spark):
    words = "running runner caresses ponies ties cats agreed plastered motoring conflated hopping falling hissing filing happy sky relational conditional vietnamization predication operator feudalism decisiveness hopefulness formalize electrical goodness revival allowance inference airliner adjustable defensible irritant replacement adoption homologous communism activate bowdlerize probate rate controlling roll generalizations oscillators".split()
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(c, tokenize='porter')")
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(f, instance)")
    con.executemany("INSERT INTO f(rowid, c) VALUES (?, ?)", list(enumerate(words)))
    want = {i: t for t, i in con.execute("SELECT term, doc FROM v")}
    assert {w: porter.stem(w) for w in words} == {w: want[i] for i, w in enumerate(words)}


def test_scores_and_empty_queries(spark, docs):
    assert lexical.bm25(docs, queries(spark, "", "zzz", "c++ hello-world")).count() == 0
    one = spark.range(1).select(lexical.display_score(F.lit(-1.0)).alias("a"), lexical.display_score(F.lit(-5.0)).alias("b")).first()
    assert (one["a"], round(one["b"], 3)) == (0.5, 0.167)
    top = lexical.bm25_search(docs, queries(spark, "beta"), limit=2)
    assert [r["rank"] for r in top.orderBy("rank").collect()] == [1, 2]
    none = docs.select("collection_id").where("false")
    assert lexical.bm25_search(docs, queries(spark, "beta"), collections=none).count() == 0


def test_vectors(spark):
    e = spark.createDataFrame([(0, 0, [1.0, 0.0]), (1, 0, [0.0, 1.0]), (2, 1, [0.0, 0.0])], "embedding_id long, document_id long, embedding array<float>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, embedding array<float>")
    got = {r["embedding_id"]: r["score"] for r in vector.knn(e, q, 3).collect()}
    assert got[0] == 1.0 and abs(got[1] - (1 - 2**0.5 / 2)) < 1e-9
    allowed = spark.createDataFrame([(1,)], "document_id long")
    assert vector.knn(e, q, 1, allowed=allowed).count() == 0
    assert vector.knn(e, q, 1, allowed=allowed, filter_mode="pre").count() == 1
    assert spark.range(1).select(V.l2_normalize(F.array(F.lit(0.0), F.lit(0.0))).alias("v")).first()["v"] == [0.0, 0.0]
    with pytest.raises(Exception, match="dimension mismatch"):
        vector.check_dimension(e, 3).collect()
    with pytest.raises(ValueError):
        vector.knn(e, q, metric="dot")
    out = vector.embed_texts(q.select(F.lit("x").alias("content")), lambda: lambda ts: [[1.0, 2.0] for _ in ts])
    assert out.first()["embedding"] == [1.0, 2.0]


def lists(spark, *ls):
    rows = [(0, i, p + 1, d, 1.0 - p / 10) for i, x in enumerate(ls) for p, d in enumerate(x)]
    return spark.createDataFrame(rows, "query_id long, list_idx int, position int, document_id string, score double")


def test_rrf(spark):
    got = {r["document_id"]: r for r in fusion.rrf(lists(spark, ["a", "b"], ["a", "c"])).collect()}
    assert abs(got["a"]["rrf_score"] - 2 / 61) < 1e-12 and got["a"]["rank"] == 1
    assert got["b"]["rank"] == 2 and got["c"]["rank"] == 3  # a tie keeps the order of the lists
    assert got["a"]["bm25_score"] == 1.0 and got["b"]["vector_score"] is None
    twice = fusion.rrf(lists(spark, ["a", "a"])).first()["rrf_score"]
    assert abs(twice - (1 / 61 + 1 / 62)) < 1e-12
    assert abs(fusion.rrf(lists(spark, ["a", "a"]), dedup_lists=True).first()["rrf_score"] - 1 / 61) < 1e-12
    with pytest.raises(ValueError):
        fusion.rrf(lists(spark, ["a"]), weights=[0.0])


def test_expansion_and_routing(spark):
    v = fusion.expand_queries(spark, queries(spark, "search error", "nothing"))
    assert [r["query"] for r in v.where("query_id = 0").orderBy("variant_idx").collect()] == ["search error", "search error find", "search error lookup", "search error query"]
    u = spark.createDataFrame([(0, i, x) for i, x in enumerate(["query", "query", "QUERY", "variant"])], "query_id long, variant_idx int, query string")
    assert [r["query"] for r in fusion.unique_variants(u).orderBy("variant_idx").collect()] == ["query", "variant"]
    r = queries(spark, "lex: a b", "plain").select(fusion.route(F.col("query")).alias("r")).collect()
    assert [tuple(x["r"]) for x in r] == [("lex", "a b"), ("hybrid", "plain")]
    with pytest.raises(ValueError):
        fusion.create_reranker("unknown", {})


def test_evaluation(spark):
    res = spark.createDataFrame([(0, "a", 1), (1, "x", 1), (1, "b", 2)], "query_id long, document_id string, rank int")
    j = spark.createDataFrame([(0, "a"), (1, "b"), (1, "c")], "query_id long, document_id string")
    row = evaluation.evaluate(res, j, queries(spark, "p", "q", "r"), (1, 5)).first()
    assert abs(row["mrr"] - 0.5) < 1e-9 and row["num_queries"] == 3.0
    assert abs(row["precision_5"] - (0.2 + 0.2) / 3) < 1e-9 and abs(row["recall_5"] - 1.5 / 3) < 1e-9


@pytest.mark.parametrize("text", ["", "x", "word " * 700, "a" * 2500, "line\n" * 450])
def test_fixed_chunks(text):
    got = list(chunking.fixed(text, 1000, 100))
    assert "".join(text.split()) == "" or got
    for body, a, b in got:
        assert body == text[a:b].strip() and body
    with pytest.raises(ValueError):
        list(chunking.fixed("x", 10, 10))


def test_chunkers(spark):
    md = "lost\n# One\ntext\n## Two\nmore"
    assert [c for c, *_ in chunking.chunk_text(md)] == ["# One\ntext", "## Two\nmore"]
    assert [c for c, *_ in chunking.chunk_text(md, "markdown", keep_preamble=True)][0] == "lost"
    assert [c for c, *_ in chunking.chunk_text("import x\ndef f():\n  pass\nclass A:\n  pass")] == ["def f():\n  pass", "class A:\n  pass"]
    df = spark.createDataFrame([(1, md), (2, None)], "document_id long, content string")
    assert [(r["document_id"], r["sequence"]) for r in chunking.chunk_documents(df).orderBy("sequence").collect()] == [(1, 0), (1, 1)]
    with pytest.raises(ValueError):
        chunking.chunk_documents(df, "other")


def test_text_functions(spark):
    row = spark.createDataFrame([("  a \n b ", "Hello, World!  Foo", "x/y.TXT", "é" * 10)], "a string, b string, p string, u string").select(
        T.normalize_text(F.col("a")).alias("n"), T.slugify(F.col("b")).alias("s"), T.stem(F.col("p")).alias("st"), T.suffix(F.col("p")).alias("x"), T.truncate_bytes(F.col("u"), 19).alias("u")
    ).first()
    assert tuple(row) == ("a b", "hello-world-foo", "y", ".txt", "é\n... [truncated]")


def test_titles(spark):
    rows = [("\t\n \u00a0 \nfirst\t\n", "a/x.txt"), ('x = """no"""\n"""\n  The title. \nmore"""', "a/y.py"), ("x = 1", "b/z.py"), ('"""one\ntwo"""', "b/q.tsx")]
    got = spark.createDataFrame(rows, "t string, p string").select(T.text_title(F.col("t"), F.col("p")).alias("a"), T.code_title(F.col("t"), F.col("p")).alias("b"), T.code_language(F.col("p")).alias("c")).collect()
    assert got[0]["a"] == "first" and [r["b"] for r in got[1:]] == ["The title.", "z", "q"] and got[3]["c"] == "tsx"
    cut = spark.createDataFrame([("é" * 60,), ("x" * 100,), ("x" * 101,)], "u string").select(T.truncate_bytes(F.col("u"), 100).alias("u")).collect()
    assert [len(r["u"].encode()) for r in cut] == [100, 100, 100] and cut[1]["u"] == "x" * 100


def test_upsert_takes_the_last_of_equal_keys(spark):
    old = spark.createDataFrame([("k", "a", 1)], "id string, content string, updated_at long")
    new = spark.createDataFrame([("k", "b", 5), ("k", "c", 5), ("k", "z", 4), ("n", "d", 1)], old.schema)
    for part in (1, 4):
        assert {tuple(r) for r in catalog.upsert(old, new.repartition(part), ["id"]).collect()} == {("k", "c", 5), ("n", "d", 1)}


def test_scan_and_parse(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "a.md").write_text("---\ntitle: Named\ntags: [x, y]\n---\n# Head\nbody\n")
    (tmp_path / "sub" / "b.md").write_text("# Head b\ntext")
    (tmp_path / "node_modules" / "c.md").write_text("no")
    (tmp_path / "d.txt").write_text("no")
    got = {r["path"]: r for r in files.parse(files.scan(spark, str(tmp_path))).collect()}
    assert {k: r["title"] for k, r in got.items()} == {"a.md": "Named", "sub/b.md": "Head b"}
    assert json.loads(got["a.md"]["metadata"]["tags"]) == ["x", "y"] and got["a.md"]["content"].startswith("# Head")


def test_fixture(spark, tmp_path):
    p = tmp_path / "f.json"
    p.write_text(json.dumps({"queries": [{"query": "q", "relevant_docids": ["1"]}]}))
    assert files.read_fixture(spark, str(p)).first()["relevant_docids"] == ["1"]
    p.write_text(json.dumps({"queries": [{"query": "q"}]}))
    with pytest.raises(ValueError):
        files.read_fixture(spark, str(p))


def test_catalog(spark, docs):
    tables = catalog.create_all(spark)
    assert all(t.count() == 0 for t in tables.values())
    bad = spark.createDataFrame([("1", "t", "odd")], "context_id string, target_id string, context_type string")
    with pytest.raises(Exception, match="unknown context type"):
        catalog.valid_contexts(bad).collect()
    kept = catalog.byte_budget(docs.withColumn("collection_id", F.lit("c")), 40)
    sizes = dict(TEXTS)
    used, want = 0, []
    for i, t in TEXTS:
        if used + len(t) <= 40:
            used, want = used + len(t), [*want, i]
    assert sorted(r["document_id"] for r in kept.collect()) == want and sizes
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, checksum string")
    new = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "path string, checksum string")
    assert {r["path"]: r["status"] for r in catalog.index_diff(new, old).collect()} == {"a": "unchanged", "b": "changed", "c": "removed", "d": "new"}
    assert sorted(tuple(r) for r in catalog.index_apply(new, old).select("path", "checksum").collect()) == [("a", "1"), ("b", "9"), ("d", "4")]
    c = spark.createDataFrame([("1", "one", True)], "collection_id string, name string, include_by_default boolean")
    with pytest.raises(ValueError):
        catalog.add_collection(c, c)
    assert catalog.rename_collection(c, "one", "two").first()["name"] == "two"
    assert S.call_get(spark, docs, "4.md").first()["document_id"] == 4


def test_sinks_escape(spark):
    r = spark.createDataFrame([(0, 1, 7, 'a "b", <c>', "p", 0.5)], "query_id long, rank int, document_id long, title string, path string, score double")
    line = lambda k: sinks.result_lines(r, k).first()["line"]
    assert line("csv") == '1,7,"a ""b"", <c>",p,0.5000'
    assert "&lt;c&gt;" in line("xml") and json.loads(line("json"))["document_id"] == 7


def test_watch(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    rows = [("2024-01-01T00:00:00Z", "a.md", "created"), ("2024-01-01T00:00:05Z", "a.md", "deleted"), ("2024-01-01T00:00:01Z", "b.exe", "created")]
    (d / "1.json").write_text("\n".join(json.dumps({"ts": t, "path": p, "event_type": e}) for t, p, e in rows))
    seen = []
    q = watch.watch(watch.file_events(spark, str(d), ["md"]), lambda df, i: seen.extend((r["path"], r["event_type"]) for r in df.collect()), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert seen == [("a.md", "deleted")]


def test_pipeline(spark, docs):
    out = S.search(spark, docs, queries(spark, "lex: beta", "beta gamma")).collect()
    assert {r["query_id"] for r in out} == {0, 1} and all(r["snippet"] for r in out)
    with pytest.raises(ValueError):
        S.SearchOptions(limit=0)


def test_full_pipeline_asks_all_query_vectors(spark, monkeypatch):
    from lexmill.plans import queries as Q
    from lexmill.plans import tables as D

    kept, d = [], "/root/testdata/sf0.001"
    search = Q.S.search
    monkeypatch.setattr(Q.S, "search", lambda *a, embed, **k: (kept.append(embed), search(*a, embed=embed, **k))[1])
    Q.full_pipeline(spark, d)
    asked = kept[0](spark.range(2000).selectExpr("id AS query_id", "concat('q', id) AS query"))
    emb = {tuple(r["embedding"]): r["embedding_id"] for r in D.embeddings(spark, d).collect()}
    got = [emb[tuple(r["embedding"])] for r in asked.collect()]
    assert len(got) == 2000 and set(got) == {i for i in emb.values() if i % 20 == 0}


def test_index_files_counts_failures(spark):
    files_ = spark.createDataFrame([("a.md", "# A\nx", 5, 1.0), ("b.md", None, 3, 1.0), ("c.md", "same", 4, 1.0), ("d.zip", "z", 1, 1.0)], "path string, content string, file_size long, mtime double")
    old = files.parse(spark.createDataFrame([("b.md", "old b", 5, 0.0), ("c.md", "same", 4, 0.0), ("e.md", "gone", 4, 0.0)], files_.schema))
    from lexmill.plans import maintain

    now, report = maintain.index_files(files_, old)
    assert {r["path"]: r["content"] for r in now.collect()} == {"a.md": "# A\nx", "b.md": "old b", "c.md": "same"}
    assert report.first().asDict() == {"processed": 2, "added": 1, "updated": 0, "skipped": 1, "failed": 1}


def test_embed_through_the_cache(spark):
    from lexmill.plans import maintain

    rows = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x"), (4, None)], "document_id long, content string")
    cache = spark.createDataFrame([("m", [5.0])], "model_id string, embedding array<double>").withColumn("content_hash", F.sha2(F.lit("y"), 256))
    out, after = maintain.embed_texts(rows, cache, "m", lambda t: t.withColumn("embedding", F.array(F.lit(1.0))))
    assert {r["document_id"]: r["embedding"] for r in out.where("document_id < 4").collect()} == {1: [1.0], 2: [5.0], 3: [1.0]}
    assert after.where("content_hash is not null").count() == 2
    assert catalog.cache_clear(after, "m").count() == 0 and catalog.cache_clear(after).count() == 0


def test_bench_fixture(spark, docs, tmp_path):
    from lexmill.plans import maintain

    p = tmp_path / "f.json"
    p.write_text(json.dumps({"queries": [{"query": "lex: beta", "relevant_docids": ["1", "2"]}, {"query": "lex: nothing", "relevant_docids": ["1"]}]}))
    row = maintain.bench_fixture(spark, files.read_fixture(spark, str(p)), docs)
    got = row.first().asDict()
    assert got["num_queries"] == 2 and 0 < got["mrr"] <= 0.5 and 0 < got["recall_10"] <= 0.5


def test_lists_and_tree(spark):
    ctx = spark.createDataFrame([("3", "b", "path", "x"), ("1", "a", "path", "y"), ("2", "c", "global", "z")], "context_id string, target_id string, context_type string, content string")
    assert [r["context_id"] for r in catalog.list_contexts(ctx).collect()] == ["2", "1", "3"]
    assert [r["context_id"] for r in catalog.list_contexts(ctx, "path", "b").collect()] == ["3"]
    assert catalog.remove_context(ctx, "3").count() == 2
    with pytest.raises(ValueError):
        catalog.list_contexts(ctx, "other")
    paths = spark.createDataFrame([("a/b/c.md",), ("a/d.md",), ("top.md",)], "path string")
    assert {(r["level"], r["folder"]): r["n_documents"] for r in catalog.path_tree(paths).collect()} == {(1, "a"): 2, (2, "a/b"): 1}


def test_highlights_without_chunks(spark):
    docs_ = spark.createDataFrame([(1, "word " * 10 + "needle here"), (2, "needle " + "x" * 2000)], "document_id long, content string")
    chunks = chunking.chunk_strided(docs_.where("document_id = 1"))
    found = spark.createDataFrame([(0, 1), (0, 2)], "query_id long, document_id long")
    terms = lexical.query_terms(queries(spark, "needle"))
    assert {r["document_id"] for r in lexical.highlights(chunks, found, terms).collect()} == {1}
    assert {r["document_id"] for r in lexical.highlights(chunks, found, terms, documents=docs_).collect()} == {1, 2}


def test_search_finds_word_forms(spark):
    docs_ = spark.createDataFrame([(1, "he was running"), (2, "a café"), (3, "nothing")], "document_id long, content string")
    got = lexical.bm25(docs_, queries(spark, "runs", "cafe", "runs cafe"))
    assert {(r["query_id"], r["document_id"]) for r in got.collect()} == {(0, 1), (1, 2)}
    assert lexical.bm25(docs_, queries(spark, "runs", "cafe"), stems=False).count() == 0
