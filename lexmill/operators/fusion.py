"""Fusion of ranked lists, query expansion, reranking.

A ranked list row is (query_id, list_idx, position, document_id, score). All lists of a query are fused in one aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.functions import vectors as V

RRF_K = 60
#: Query word -> synonyms.
SYNONYMS = {
    "python": ["py", "cpython"],
    "search": ["find", "lookup", "query"],
    "index": ["catalog", "register"],
    "document": ["doc", "file", "page"],
    "config": ["configuration", "settings"],
}


def rrf_score(rank: Column, k: int = RRF_K) -> Column:
    return 1 / (k + rank)


def as_list(results: DataFrame, list_idx: int, score: str = "score") -> DataFrame:
    """A result set as one list: position 1.. by its order, whatever gaps its ranks have."""
    w = Window.partitionBy("query_id").orderBy("rank")
    return results.select("query_id", F.lit(list_idx).alias("list_idx"), F.row_number().over(w).alias("position"), "document_id", F.col(score).alias("score"))


def rrf(lists: DataFrame, limit: int = 10, k: int = RRF_K, weights: list[float] | None = None, dedup_lists: bool = False) -> DataFrame:
    """(query_id, document_id, rrf_score, bm25_score, vector_score, rank).

    A document that a list repeats counts each time unless ``dedup_lists``. Ties keep first-seen order. ``weights``, one for each
    list, are normalised to sum 1. ``bm25_score`` is the score in list 0, ``vector_score`` the last other list's.
    """
    if dedup_lists:
        lists = lists.groupBy("query_id", "list_idx", "document_id").agg(F.min("position").alias("position"), F.max("score").alias("score"))
    part = rrf_score(F.col("position"), k)
    if weights is not None:
        if not weights or sum(weights) <= 0:
            raise ValueError("weights must sum to more than 0")
        share = F.create_map(*[F.lit(x) for i, w in enumerate(weights) for x in (i, w / sum(weights))])
        part = F.coalesce(F.element_at(share, F.col("list_idx")), F.raise_error(F.lit("a list has no weight"))) * part
    # (list, place) is one number, so that the order in which lists are seen is one minimum
    seen = F.struct("list_idx", "position")
    fused = lists.groupBy("query_id", "document_id").agg(
        F.sum(part).alias("rrf_score"),
        F.max(F.when(F.col("list_idx") == 0, F.struct(-F.col("position"), "score"))).alias("l"),
        F.max(F.when(F.col("list_idx") > 0, F.struct("list_idx", -F.col("position"), "score"))).alias("v"),
        F.min(seen).alias("seen"),
    )
    w = Window.partitionBy("query_id").orderBy(F.round("rrf_score", 12).desc(), "seen")
    fused = fused.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
    return fused.select("query_id", "document_id", "rrf_score", F.col("l.score").alias("bm25_score"), F.col("v.score").alias("vector_score"), "rank")


def hybrid(lexical: DataFrame, vector: DataFrame, limit: int = 10, k: int = RRF_K) -> DataFrame:
    """Both legs fused; a query with one empty leg keeps the other leg's scores. Documents are unique, the best stays."""
    lists = as_list(lexical, 0).unionByName(as_list(vector, 1))
    legs = lists.groupBy("query_id").agg(F.count_distinct("list_idx").alias("legs"))
    fused = rrf(lists, limit, k)
    single = dedup_best(lists.join(legs.where("legs = 1"), "query_id", "left_semi").select("query_id", "document_id", "score", "position"))
    kept = fused.join(legs, "query_id").join(single.select("query_id", "document_id", F.col("score").alias("raw")), ["query_id", "document_id"], "left")
    return kept.select("query_id", "document_id", F.when(F.col("legs") == 1, F.col("raw")).otherwise(F.col("rrf_score")).alias("score"), "bm25_score", "vector_score", "rank")


def dedup_best(results: DataFrame) -> DataFrame:
    """One row a document, the highest score (then the first position)."""
    w = Window.partitionBy("query_id", "document_id").orderBy(F.desc("score"), "position")
    return results.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def linear_fusion(lexical: DataFrame, vector: DataFrame, lexical_weight: float = 0.5) -> DataFrame:
    """Weighted sum of two legs' scores; a missing score counts 0."""
    a = lexical.select("query_id", "document_id", F.col("score").alias("a"))
    b = vector.groupBy("query_id", "document_id").agg(F.max("score").alias("b"))
    both = a.join(b, ["query_id", "document_id"], "full_outer")
    score = lexical_weight * F.coalesce("a", F.lit(0.0)) + (1 - lexical_weight) * F.coalesce("b", F.lit(0.0))
    return both.select("query_id", "document_id", score.alias("score"))


def route(query: Column) -> Column:
    """Struct (kind, text) by the prefix lex:, vec:, hyde: or expand:; else hybrid."""
    kind = F.regexp_extract(query, "(?i)^(lex|vec|hyde|expand):", 1)
    return F.struct(F.when(kind == "", "hybrid").otherwise(F.lower(kind)).alias("kind"), F.when(kind == "", query).otherwise(F.trim(F.regexp_replace(query, "(?i)^(lex|vec|hyde|expand):", ""))).alias("text"))


def with_intent(query: Column, intent: Column) -> Column:
    return F.when(intent.isNull() | (intent == ""), query).otherwise(F.concat(intent, F.lit(": "), query))


def expand_queries(spark: SparkSession, queries: DataFrame, factor: int = 3, synonyms: dict[str, list[str]] | None = None, embed=None) -> DataFrame:
    """(query_id, variant_idx, query): the query, then "query term" for its words' synonyms, in word and synonym order.

    ``embed`` (a Column of texts to a Column of vectors): the terms nearest to the query by cosine come first instead.
    """
    rows = [(w, i, s) for w, every in (SYNONYMS if synonyms is None else synonyms).items() for i, s in enumerate(every)]
    table = spark.createDataFrame(rows, "word string, syn_pos int, synonym string")
    words = queries.select("query_id", "query", F.posexplode(F.split(F.lower("query"), r"\s+")).alias("word_pos", "word"))
    found = words.join(table, "word").where(~F.array_contains(F.split(F.lower("query"), r"\s+"), F.col("synonym")))
    first = Window.partitionBy("query_id", "synonym").orderBy("word_pos", "syn_pos")
    found = found.withColumn("nth", F.row_number().over(first)).where("nth = 1")
    if embed is not None:
        near = F.round(V.cosine(embed(F.col("query")), embed(F.col("synonym"))), 9)
        found = found.withColumn("near", near)
    w = Window.partitionBy("query_id").orderBy(*([F.desc("near"), "synonym"] if embed is not None else ["word_pos", "syn_pos"]))
    found = found.withColumn("variant_idx", F.row_number().over(w)).where(F.col("variant_idx") <= factor)
    variants = found.select("query_id", "variant_idx", F.concat_ws(" ", "query", "synonym").alias("query"))
    return queries.select("query_id", F.lit(0).alias("variant_idx"), "query").unionByName(variants)


def unique_variants(variants: DataFrame, key: str = "query_id") -> DataFrame:
    """Variants without repeats (any case), first one stays, numbered again."""
    w = Window.partitionBy(key, F.lower("query")).orderBy("variant_idx")
    kept = variants.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")
    return kept.withColumn("variant_idx", F.row_number().over(Window.partitionBy(key).orderBy("variant_idx")) - 1)


def unique_batch(variants: DataFrame) -> DataFrame:
    """(query, query_id, variant_idx) of a batch's distinct variants, with where each came first: the batch's order."""
    first = variants.groupBy("query").agg(F.min(F.struct("query_id", "variant_idx")).alias("at"))
    return first.select("query", F.col("at.query_id").alias("query_id"), F.col("at.variant_idx").alias("variant_idx"))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def rerank(results: DataFrame, score: Column, top_k: int = 10, candidates: int | None = None) -> DataFrame:
    """Results ordered by a new score; only the first ``candidates`` take part."""
    rows = results if candidates is None else results.where(F.col("rank") <= candidates)
    rows = rows.withColumn("reranker_score", score)
    w = Window.partitionBy("query_id").orderBy(F.round("reranker_score", 9).desc(), "rank", "document_id")
    return rows.withColumn("new_rank", F.row_number().over(w)).where(F.col("new_rank") <= top_k)


def rerank_text(title: Column, content: Column, highlight: Column) -> Column:
    """The content, or the highlight if it is null or empty, below the title; the title alone if there is neither."""
    empty = lambda c: c.isNull() | (c == "")
    body = F.when(~empty(content), content).otherwise(F.coalesce(highlight, F.lit("")))
    return F.when(empty(title), body).when(body == "", title).otherwise(F.concat(title, F.lit("\n\n"), body))


def yes_probability(yes: Column, no: Column) -> Column:
    """Softmax of two logits."""
    return 1 / (1 + F.exp(no - yes))


def create_reranker(model: str, scorers: dict, model_type: str = "gguf"):
    """The caller's scorer for a model: ``causal`` by its name, else ``bi`` or ``cross`` by ``model_type``."""
    if "qwen3-reranker" in model.lower() or "qwen3_reranker" in model.lower():
        kind = "causal"
    else:
        kind = {"gguf": "bi", "sentence_transformers": "cross"}.get(model_type)
    if kind is None:
        raise ValueError(f"unknown reranker type {model_type}")
    if kind not in scorers:
        raise ValueError(f"no {kind} scorer for {model}")
    return scorers[kind]
