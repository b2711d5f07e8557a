"""The engine's tables made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import chunking, lexical
from lexmill.sources.index_store import IndexStore
from lexmill.sources.stored import once


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def documents(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(
        F.col("doc_id").alias("document_id"), F.col("source").alias("collection_id"), F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("path"), F.col("text").alias("content")
    )
    return rows.withColumns({"filename": T.basename(F.col("path")), "title": T.text_title(F.col("content"), F.col("path")), "checksum": F.sha2("content", 256), "file_size": F.octet_length("content").cast("long")})


def collections(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(F.col("source").alias("collection_id")).distinct()
    return rows.select("collection_id", F.col("collection_id").alias("name"), (F.regexp_extract("collection_id", "([0-9]+)$", 1).cast("int") % 2 == 0).alias("include_by_default"))


def embeddings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("embedding_id"), F.expr("vec_id div 2").alias("document_id"), F.expr("cast(vec_id % 2 as int)").alias("sequence"), "embedding")


def index(spark: SparkSession, d: str) -> lexical.Index:
    """The stored index of the documents, built by the first query of the application that asks for it."""
    return once(spark, f"{d}/documents", lambda s: _built(spark, s.base, documents(spark, d)))


def _built(spark: SparkSession, path: str, rows: DataFrame, key: str = "document_id") -> lexical.Index:
    store = IndexStore(spark, path, key)
    store.write(rows)
    return store.index()


def changed_index(spark: SparkSession, d: str) -> IndexStore:
    """A durable index of four fifths of the documents, to which the rest was added while some were replaced and others deleted."""

    def make(s) -> IndexStore:
        store, rows = IndexStore(spark, s.base), documents(spark, d)
        store.write(rows.where("document_id % 5 < 4"))
        more = F.when(F.col("document_id") % 10 == 1, F.concat("content", F.lit(" the of extra"))).otherwise(F.col("content"))
        store.write(rows.where("document_id % 5 = 4 or document_id % 10 = 1").withColumn("content", more), rows.where("document_id % 7 = 0").select("document_id"))
        return store

    return once(spark, f"{d}/changed", make)


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_strided(documents(spark, d)).withColumn("chunk_id", F.col("document_id") * 100000 + F.col("sequence"))


def chunk_index(spark: SparkSession, d: str) -> lexical.Index:
    return once(spark, f"{d}/chunks", lambda s: _built(spark, s.base, chunks(spark, d), "chunk_id"))


def queries(spark: SparkSession, d: str, n_terms: int = 2) -> DataFrame:
    """Queries (query_id, query): the words that occur most often in a benchmark item's whole text, the first one of equals first.
    Stored by the first query of the application that asks for them."""
    return once(spark, f"{d}/queries-{n_terms}", lambda s: s.save(_queries(spark, d, n_terms), "queries"))


def _queries(spark: SparkSession, d: str, n_terms: int) -> DataFrame:
    words = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.posexplode_outer(T.tokens(F.col("text"))).alias("pos", "token"))
    each = words.groupBy("query_id", "token").agg(F.count("pos").alias("n"), F.min("pos").alias("pos"))
    best = each.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "pos", "token"))), 1, n_terms).alias("t"))
    return best.select("query_id", F.array_join(F.transform("t", lambda x: x["token"]), " ").alias("query"))


def query_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The query set: every vector whose id is divisible by 20."""
    return table(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def judgements(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, document_id): the labelled good documents of a query's share of the corpus (ids modulo the number of items)."""
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"))
    good = table(spark, d, "labels").where("quality = 1").crossJoin(items.agg(F.count("*").alias("n")))  # one row
    return good.select(F.col("doc_id").alias("document_id"), F.try_mod("doc_id", "n").alias("query_id")).join(items, "query_id", "left_semi")


def contexts(spark: SparkSession, d: str) -> DataFrame:
    """A path context for every seventh document, as many for paths that do not exist, a context for every collection."""
    day = lambda c: F.timestamp_seconds(c * 86400)
    docs = documents(spark, d).where("document_id % 7 = 0")
    cols = lambda i, t, k, c: [i.alias("context_id"), t.alias("target_id"), F.lit(k).alias("context_type"), c.alias("content"), day(F.col("document_id")).alias("created_at"), day(F.col("document_id") + 1).alias("updated_at")]
    own = docs.select(*cols(F.concat(F.lit("p"), "document_id"), F.col("path"), "path", F.concat(F.lit("about "), "document_id")))
    lost = docs.select(*cols(F.concat(F.lit("o"), "document_id"), F.concat(F.lit("gone/"), "path"), "path", F.lit("orphan")))
    coll = collections(spark, d).withColumn("document_id", F.lit(1)).select(*cols(F.concat(F.lit("c"), "collection_id"), F.col("collection_id"), "collection", F.concat(F.lit("all of "), "collection_id")))
    return own.unionByName(lost).unionByName(coll)


def headed(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as markdown: a heading for every turn."""
    line = F.concat(F.lit("# "), "role", F.lit(" "), F.col("turn").cast("string"), F.lit("\n"), F.trim("text"))
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("x"))
    return rows.select(F.col("conv_id").alias("document_id"), F.array_join(F.transform("x", lambda s: s["line"]), "\n").alias("content"))


def old_index(spark: SparkSession, d: str) -> DataFrame:
    """An earlier snapshot: one document in ten is missing, one in ten changed, and a removed one for each of the tenth."""
    docs = documents(spark, d)
    last = F.col("document_id") % 10
    kept = docs.where(last != 0).withColumn("checksum", F.when(last == 1, F.sha2(F.concat("content", F.lit("!")), 256)).otherwise(F.col("checksum")))
    gone = docs.where(last == 2).withColumn("path", F.concat(F.lit("old/"), "path"))
    return kept.unionByName(gone)
