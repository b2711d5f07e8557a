"""The search pipeline for a table of queries, and the four service calls."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators import catalog, fusion, lexical, snippets, vector
from lexmill.sources import files


@dataclass(frozen=True)
class SearchOptions:
    limit: int = 10
    offset: int = 0
    min_score: float | None = 0.0
    include_content: bool = False
    max_highlights: int = 3
    candidate_limit: int = 20
    snippet_max_length: int = 300
    rrf_k: int = 60
    expansion_factor: int = 3
    metric: str = "l2"
    filter_mode: str = "post"
    dedup_lists: bool = False
    stems: bool = True
    k1: float = lexical.K1
    b: float = lexical.B
    rerank_top_k: int = 100

    def __post_init__(self):
        for name, low, high in (("limit", 1, 100), ("offset", 0, 10**6), ("candidate_limit", 1, 200), ("k1", 0.1, 3.0), ("b", 0.1, 1.0), ("rerank_top_k", 1, 100), ("rrf_k", 1, 10**6), ("expansion_factor", 1, 10), ("max_highlights", 0, 100)):
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} must lie between {low} and {high}")


def legs(spark: SparkSession, documents: DataFrame, embeddings: DataFrame | None, queries: DataFrame, options: SearchOptions, collections: DataFrame | None = None, embed=None, index: lexical.Index | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(lexical, vector) results of queries (query_id, query), each (query_id, document_id, score, rank)."""
    most = max(options.limit, options.candidate_limit)
    lex = lexical.bm25_search(documents, queries, most, 0, collections, options.min_score, index, stems=options.stems, k1=options.k1, b=options.b)
    if embeddings is None:
        return lex, None
    q = embed(queries) if embed else vector.embed_texts(queries, dimension=384, text="query")
    allowed = None if collections is None else documents.join(collections.select("collection_id").distinct(), "collection_id", "left_semi").select("document_id")
    return lex, vector.knn(embeddings, q.select("query_id", "embedding"), most, options.metric, allowed, options.filter_mode, options.min_score)


def search(spark: SparkSession, documents: DataFrame, queries: DataFrame, options: SearchOptions | None = None, embeddings: DataFrame | None = None, collections: DataFrame | None = None, contexts: DataFrame | None = None, embed=None, generator=None, reranker=None, index: lexical.Index | None = None, chunks: DataFrame | None = None) -> DataFrame:
    """Routes each query by its prefix, expands it, fuses both legs of every variant and then the variants, reranks the
    candidates, and attaches a snippet and contexts.

    queries: (query_id, query, optional intent). ``embed``: queries -> queries with embedding. ``generator``: a Column function from
    prompt to answer for ``hyde:`` queries. ``reranker``: a Column function of (query, text).
    ``index``: the documents' stored index; without one their texts are tokenised for this search. ``chunks`` (document_id, sequence,
    content): a candidate without content is reranked by its first highlight among them.
    """
    o = options or SearchOptions()
    q = queries if "intent" in queries.columns else queries.withColumn("intent", F.lit(None).cast("string"))
    q = q.withColumn("r", fusion.route(F.col("query"))).select("query_id", F.col("r.kind").alias("kind"), fusion.with_intent(F.col("r.text"), F.col("intent")).alias("query"))
    variants = fusion.expand_queries(spark, q.where("kind in ('hybrid', 'expand')").select("query_id", "query"), o.expansion_factor)
    variants = fusion.unique_variants(variants).unionByName(q.where("kind in ('lex', 'vec', 'hyde')").select("query_id", F.lit(0).alias("variant_idx"), "query"))
    # a variant is a query of its own until the variants are fused
    v = variants.join(q.select("query_id", "kind"), "query_id").select(F.concat_ws("#", "query_id", "variant_idx").alias("vid"), "query_id", "variant_idx", "kind", "query")
    if generator is not None:
        prompt = F.concat(F.lit("Write a short passage that answers: "), F.col("query"))
        v = v.withColumn("query", F.when(F.col("kind") == "hyde", generator(prompt)).otherwise(F.col("query")))
    else:
        v = v.withColumn("query", F.when(F.col("kind") == "hyde", F.raise_error(F.lit("hyde: needs a generator"))).otherwise(F.col("query")))
    asked = v.select(F.col("vid").alias("query_id"), "query", "kind")
    lex_q, vec_q = asked.where("kind in ('hybrid', 'expand', 'lex')").drop("kind"), asked.where("kind in ('hybrid', 'expand', 'vec', 'hyde')").drop("kind")
    lex, _ = legs(spark, documents, None, lex_q, o, collections, index=index)
    lists = fusion.as_list(lex, 0)
    if embeddings is not None:
        _, vec = legs(spark, documents, embeddings, vec_q, o, collections, embed)
        lists = lists.unionByName(fusion.as_list(vec, 1))
    most = max(o.limit, o.candidate_limit)
    n = lists.groupBy("query_id").agg(F.count_distinct("list_idx").alias("legs"))
    fused = fusion.rrf(lists, most, o.rrf_k, dedup_lists=o.dedup_lists).join(n, "query_id")
    raw = F.coalesce(F.col("bm25_score"), F.col("vector_score"))
    fused = fused.withColumn("score", F.when(F.col("legs") == 1, raw).otherwise(F.col("rrf_score")))
    each = fused.withColumnRenamed("query_id", "vid").join(v.select("vid", "query_id", "variant_idx"), "vid")
    several = each.groupBy("query_id").agg(F.count_distinct("variant_idx").alias("variants"))
    over = fusion.rrf(each.select("query_id", F.col("variant_idx").alias("list_idx"), F.col("rank").alias("position"), "document_id", "score"), most, o.rrf_k)
    first = each.groupBy("query_id", "document_id").agg(F.max("score").alias("score"), F.max("bm25_score").alias("bm25_score"), F.max("vector_score").alias("vector_score"))
    rows = over.select("query_id", "document_id", "rrf_score", "rank").join(first, ["query_id", "document_id"]).join(several, "query_id")
    rows = rows.withColumn("score", F.when(F.col("variants") == 1, F.col("score")).otherwise(F.col("rrf_score")))
    rows = rows.join(documents.select("document_id", "title", "path", "collection_id", "content"), "document_id").join(q.select("query_id", "query"), "query_id")
    if reranker is not None:
        lit = F.lit("")
        if chunks is not None:
            marked = lexical.highlights(chunks, rows, lexical.query_terms(q.select("query_id", "query")), most=1)
            rows = rows.join(marked.select("query_id", "document_id", "highlight"), ["query_id", "document_id"], "left")
            lit = F.col("highlight")
        rows = fusion.rerank(rows, fusion.sigmoid(reranker(F.col("query"), fusion.rerank_text(F.col("title"), F.col("content"), lit))), min(o.limit, o.rerank_top_k), o.candidate_limit)
        rows = rows.withColumn("rank", F.col("new_rank"))
    rows = rows.where(F.col("rank") <= o.limit)
    rows = rows.withColumn("snippet", snippets.snippets(F.col("content"), F.split("query", r"\s+"), o.snippet_max_length))
    out = ["query_id", "document_id", "title", "path", "collection_id", "score", "bm25_score", "vector_score", "rank", "snippet", *(["content"] if o.include_content else [])]
    rows = rows.select(*out)
    return rows if contexts is None else lexical.attach_contexts(rows, contexts)


# the service calls


def call_query(spark: SparkSession, documents: DataFrame, text: str, **how) -> DataFrame:
    return search(spark, documents, spark.createDataFrame([(0, text)], "query_id long, query string"), **how)


def call_get(spark: SparkSession, documents: DataFrame, wanted: str, first: int = 1, n: int | None = None, numbers: bool = False) -> DataFrame:
    """The lines of a document by id, path or file name, else of the file at that place (path, content), if there is one; else none."""
    hit = catalog.lookup(documents, spark.createDataFrame([(wanted,)], "wanted string"))
    found = documents.join(hit.select("document_id"), "document_id", "left_semi")
    if hit.isEmpty() and files.is_file(spark, wanted):
        found = files.read_text(spark, wanted)
    return catalog.get_lines(found, first, n, numbers)


def call_multi_get(documents: DataFrame, pattern: str, max_bytes: int = 100 * 1024) -> DataFrame:
    return catalog.multi_get(documents, pattern, max_bytes)


def call_status(collections: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents by collection and, with a null collection, in all."""
    rows = documents.join(collections.select("collection_id"), "collection_id", "left_semi")
    last = "updated_at" if "updated_at" in documents.columns else None
    return rows.rollup("collection_id").agg(F.count("*").alias("document_count"), *([F.max(last).alias("last_updated")] if last else []))


