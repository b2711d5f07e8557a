"""Jobs over a whole index: indexing files, embedding chunks through a cache, running an evaluation fixture."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators import catalog, chunking, evaluation, lexical, vector
from lexmill.plans import search as S
from lexmill.sources import files as sources


def index_files(files: DataFrame, existing: DataFrame, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(next snapshot of the documents, report): a file that can't be read or parsed counts as failed and keeps its old document.

    ``files``: path, content (null: unreadable), file_size, mtime.
    """
    failed = files.where("content is null").select("path", F.lit("cannot be read as text").alias("error"))
    parsed = sources.parse(files.where("content is not null"))
    kept = existing.join(failed.select("path"), "path", "left_anti")
    diff = catalog.index_diff(parsed, kept, force)
    now = catalog.index_apply(parsed, kept, force)
    return now.unionByName(existing.join(failed.select("path"), "path", "left_semi"), allowMissingColumns=True), catalog.index_report(diff, failed)


def embed_texts(rows: DataFrame, cache: DataFrame, model_id: str, embed=None, text: str = "content") -> tuple[DataFrame, DataFrame]:
    """(rows with ``embedding``, next snapshot of the cache). Each distinct text that the cache lacks is embedded once.

    ``embed``: rows (content_hash, text) to rows with ``embedding``.
    """
    hits, misses = catalog.cache_split(rows, cache, model_id, text)
    once = misses.groupBy("content_hash").agg(F.first(text).alias(text))  # equal hashes are equal texts
    new = (embed or (lambda x: vector.embed_texts(x, text=text)))(once).select("content_hash", "embedding")
    out = hits.unionByName(misses.join(new, "content_hash"), allowMissingColumns=True)
    return out, cache.unionByName(new.withColumn("model_id", F.lit(model_id)).withColumn("created_at", F.current_timestamp()), allowMissingColumns=True)


def embed_index(documents: DataFrame, cache: DataFrame, model_id: str, strategy: str = "auto", embed=None) -> tuple[DataFrame, DataFrame]:
    """(embeddings of all chunks, next snapshot of the cache): documents are chunked anew, numbered from 0, and embedded."""
    chunks = chunking.chunk_documents(documents, strategy)
    rows, cache = embed_texts(chunks, cache, model_id, embed)
    return rows.select(F.concat_ws("#", "document_id", "sequence").alias("embedding_id"), "document_id", "sequence", "embedding"), cache


def bench_fixture(spark: SparkSession, fixture: DataFrame, documents: DataFrame, options: S.SearchOptions | None = None, **how) -> DataFrame:
    """Metrics of a fixture (query_id, query, relevant_docids, collections), in one row: every query searched, results judged.

    ``how`` goes to the search. Relevant ids are compared as strings.
    """
    judged = fixture.select("query_id", F.explode("relevant_docids").alias("document_id")).withColumn("document_id", F.col("document_id").cast("string"))
    found = S.search(spark, documents, fixture.select("query_id", "query"), options, **how)
    return evaluation.evaluate(found.withColumn("document_id", F.col("document_id").cast("string")), judged, fixture)


def rank_fixture(fixture: DataFrame, index: lexical.Index, limit: int = 10, **how) -> DataFrame:
    """The same over the lexical leg alone, from a stored index."""
    judged = fixture.select("query_id", F.explode("relevant_docids").alias("document_id"))
    return evaluation.evaluate(lexical.bm25_search(None, fixture.select("query_id", "query"), limit, index=index, **how), judged, fixture)
