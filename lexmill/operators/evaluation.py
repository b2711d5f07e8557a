"""Retrieval metrics over result tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def relevance(results: DataFrame, judgements: DataFrame) -> DataFrame:
    """Results (query_id, document_id, rank) with rel 0/1."""
    j = judgements.select("query_id", "document_id").distinct().withColumn("hit", F.lit(1))
    return results.join(j, ["query_id", "document_id"], "left").withColumn("rel", F.coalesce("hit", F.lit(0))).drop("hit")


def per_query(results: DataFrame, judgements: DataFrame, queries: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """precision_k divides by k even with fewer results; recall of no relevant document and the rank of none are 0."""
    total = judgements.select("query_id", "document_id").distinct().groupBy("query_id").agg(F.count("*").alias("relevant"))
    hits: list[Column] = [F.sum(F.when(F.col("rank") <= k, F.col("rel")).otherwise(0)).alias(f"hits_{k}") for k in ks]
    found = relevance(results, judgements).groupBy("query_id").agg(*hits, F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first_rank"))
    rows = queries.select("query_id").join(found, "query_id", "left").join(total, "query_id", "left")
    out = [F.col("query_id")]
    for k in ks:
        h = F.coalesce(F.col(f"hits_{k}"), F.lit(0))
        out += [(h / k if k else F.lit(0.0)).cast("double").alias(f"precision_{k}"), F.coalesce(F.try_divide(h, F.col("relevant")), F.lit(0.0)).alias(f"recall_{k}")]
    return rows.select(*out, F.coalesce(1 / F.col("first_rank"), F.lit(0.0)).alias("reciprocal_rank"))


def evaluate(results: DataFrame, judgements: DataFrame, queries: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Macro averages, MRR and the number of queries, in one row."""
    names = reduce(lambda a, k: [*a, f"precision_{k}", f"recall_{k}"], ks, [])
    zero = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return per_query(results, judgements, queries, ks).agg(*[zero(n).alias(n) for n in names], zero("reciprocal_rank").alias("mrr"), F.count("*").cast("double").alias("num_queries"))
