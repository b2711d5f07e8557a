"""Collections, documents, contexts and caches as tables: lookups, maintenance, snapshots.

A table is never changed in place: a write gives the next snapshot as a DataFrame, which the caller stores.
"""

from __future__ import annotations

from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.sources.stored import Stored

CONTEXT_TYPES = ("path", "collection", "global")
SCHEMAS = {
    "collections": "collection_id string, name string, path string, pattern string, ignore_patterns array<string>, include_by_default boolean, description string, created_at timestamp, updated_at timestamp, last_indexed_at timestamp, document_count long, chunk_count long, pre_update_cmd string",
    "documents": "document_id string, collection_id string, path string, filename string, title string, content string, checksum string, file_size long, mtime double, created_at timestamp, updated_at timestamp, metadata map<string,string>",
    "chunks": "chunk_id string, document_id string, sequence int, content string, start_pos int, end_pos int, token_count int, embedding_id string, created_at timestamp",
    "contexts": "context_id string, target_id string, context_type string, content string, created_at timestamp, updated_at timestamp",
    "embeddings": "embedding_id string, document_id string, chunk_id string, embedding array<float>",
    "llm_cache": "model_name string, prompt_hash string, prompt string, response string, created_at timestamp, expires_at timestamp",
    "embedding_cache": "content_hash string, model_id string, embedding array<float>, created_at timestamp",
}


def create_all(spark: SparkSession) -> dict[str, DataFrame]:
    """Empty tables."""
    return {k: spark.createDataFrame([], v) for k, v in SCHEMAS.items()}


def add_missing_columns(df: DataFrame, schema: str) -> DataFrame:
    """Columns of the schema that the table lacks, as nulls."""
    want = df.sparkSession.createDataFrame([], schema).schema
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in want if f.name not in df.columns})


# writes


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The next snapshot: new rows replace old ones of the same key. Of several new rows of a key the last by ``updated_at``, then by
    the text of the row, stays."""
    rows = old.select("*", F.lit(0).alias("prio")).unionByName(new.select("*", F.lit(1).alias("prio")))
    last = [F.desc("updated_at")] if "updated_at" in old.columns else []
    w = Window.partitionBy(*keys).orderBy(F.desc("prio"), *last, F.to_json(F.struct(*old.columns)).desc())
    return rows.withColumn("nth", F.row_number().over(w)).where("nth = 1").select(*old.columns)


def insert(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new, allowMissingColumns=True)


def delete(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(gone.select(*keys).distinct(), keys, "left_anti")


def update(old: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    return old.withColumns({k: F.when(where, v).otherwise(F.col(k)) for k, v in values.items()})


def valid_contexts(contexts: DataFrame) -> DataFrame:
    """The contexts, or an error if one has an unknown type."""
    bad = F.raise_error(F.concat(F.lit("unknown context type "), F.coalesce("context_type", F.lit("null"))))
    return contexts.withColumn("context_type", F.when(F.col("context_type").isin(*CONTEXT_TYPES), F.col("context_type")).otherwise(bad))


def add_collection(old: DataFrame, new: DataFrame) -> DataFrame:
    if not old.join(new, "name", "left_semi").limit(1).isEmpty():
        raise ValueError("a collection of that name exists")
    return insert(old, new)


def rename_collection(old: DataFrame, name: str, new: str) -> DataFrame:
    if old.where(F.col("name") == name).isEmpty():
        raise ValueError(f"no collection {name}")
    if not old.where(F.col("name") == new).isEmpty():
        raise ValueError(f"a collection {new} exists")
    return update(old, F.col("name") == name, {"name": F.lit(new)})


def set_enabled(old: DataFrame, name: str, enabled: bool) -> DataFrame:
    return update(old, F.col("name") == name, {"include_by_default": F.lit(enabled)})


def change_paths(old: DataFrame, name: str, add: list[str] | None = None, remove: list[str] | None = None) -> DataFrame:
    """A collection's ``paths`` (an array) with some added, once each and at the end, and others removed. One that isn't there raises."""
    found = old.where(F.col("name") == name).select("paths").collect()
    if not found:
        raise ValueError(f"no collection {name}")
    have = found[0]["paths"] or []
    if lost := [p for p in remove or [] if p not in have]:
        raise ValueError(f"{name} has no path {lost[0]}")
    paths = [p for p in dict.fromkeys([*have, *(add or [])]) if p not in (remove or [])]
    return update(old, F.col("name") == name, {"paths": F.array(*[F.lit(p) for p in paths]).cast("array<string>")})


def show_collection(tables: dict[str, DataFrame], name: str) -> DataFrame:
    """A collection's row with its numbers of documents, chunks and bytes; none of that name raises."""
    row = tables["collections"].where(F.col("name") == name)
    if row.isEmpty():
        raise ValueError(f"no collection {name}")
    docs = tables["documents"].join(row.select("collection_id"), "collection_id", "left_semi")
    sizes = docs.agg(F.count("*").alias("n_documents"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("n_bytes"))
    chunks = tables["chunks"].join(docs.select("document_id"), "document_id", "left_semi").agg(F.count("*").alias("n_chunks"))
    return row.crossJoin(sizes).crossJoin(chunks)  # one row each


def existing(rows: DataFrame, wanted: DataFrame, key: str = "document_id") -> DataFrame:
    """(key, there) for every distinct wanted key."""
    have = rows.select(key).distinct().withColumn("there", F.lit(True))
    return wanted.select(key).distinct().join(have, key, "left").withColumn("there", F.coalesce("there", F.lit(False)))


def drop_collection(tables: dict[str, DataFrame], collection_id: str) -> dict[str, DataFrame]:
    """Cascade: the collection, its documents, and their chunks and embeddings."""
    gone = tables["documents"].where(F.col("collection_id") == collection_id).select("document_id")
    out = dict(tables)
    out["collections"] = tables["collections"].where(F.col("collection_id") != collection_id)
    out["documents"] = tables["documents"].where(F.col("collection_id") != collection_id)
    for t in ("chunks", "embeddings"):
        if t in tables:
            out[t] = delete(tables[t], gone, ["document_id"])
    return out


# lookups


def lookup(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """(wanted, document_id): by id, else by path, else by file name; the smallest id of several."""
    w = wanted.select("wanted").distinct()
    hits = [w.join(documents.select("document_id", F.col(c).cast("string").alias("wanted")), "wanted").withColumn("prio", F.lit(p)) for p, c in enumerate(("document_id", "path", "filename"))]
    rows = hits[0].unionByName(hits[1]).unionByName(hits[2])
    return rows.groupBy("wanted").agg(F.min(F.struct("prio", "document_id")).alias("x")).select("wanted", F.col("x.document_id").alias("document_id"), F.col("x.prio").alias("matched_by"))


def get_lines(documents: DataFrame, first: int = 1, n: int | None = None, numbers: bool = False) -> DataFrame:
    body = T.line_slice(F.col("content"), first, n)
    return documents.withColumn("content", T.line_numbers(body, first) if numbers else body)


def multi_get(documents: DataFrame, pattern: str, max_bytes: int = 100 * 1024) -> DataFrame:
    """Documents whose path or file name matches a glob, or any of a comma list, cut to ``max_bytes``."""
    parts = [p.strip() for p in pattern.split(",") if p.strip()]
    hit = F.lit(False)
    for p in parts:
        hit = hit | T.glob_match(F.col("path"), p) | T.glob_match(F.col("filename"), p)
    return documents.where(hit).withColumn("content", T.truncate_bytes(F.col("content"), max_bytes))


#: Candidates of a group that one task folds.
FOLD = 100_000


def byte_budget(documents: DataFrame, budget: int, group: str = "collection_id", order: str = "document_id") -> DataFrame:
    """Documents of each group in order while they fit the budget; one that does not fit is skipped and does not count.

    The sum is not monotone, so what is taken is a fold over a group's keys and sizes. A group of more than ``FOLD`` candidates is first
    cut down in rounds, none of which has it in one task: sums over sorted ranges find the run that fits, the run is taken, and what is
    larger than the remainder goes, like the document that ended the run. A null size is 0; a null group or key is in no result.
    """
    fields = {f.name: f.dataType.simpleString() for f in documents.schema}
    size = F.coalesce(F.col("file_size").cast("long"), F.lit(0))
    rows = documents.select(F.col(group).alias("g"), F.col(order).alias("o"), size.alias("size"), F.lit(int(budget)).cast("long").alias("left")).where("size <= left")
    stored, taken, n = Stored(documents.sparkSession, "budget"), [], 0
    while not (hot := rows.groupBy("g").count().where(F.col("count") > FOLD)).isEmpty():
        big = rows.join(hot.select("g"), "g", "left_semi")
        placed = stored.save(big.repartitionByRange("g", "o").sortWithinPartitions("g", "o").withColumn("at", F.monotonically_increasing_id()), f"placed-{n}").withColumn("part", F.shiftright("at", 33))
        sums = placed.groupBy("g", "part").agg(F.sum("size").alias("own"))  # a row for each range that a group is in
        before = sums.select("g", "part", (F.sum("own").over(Window.partitionBy("g").orderBy("part")) - F.col("own")).alias("before"))
        run = placed.join(before, ["g", "part"]).withColumn("upto", F.col("before") + F.sum("size").over(Window.partitionBy("g", "part").orderBy("at")))
        ends = run.groupBy("g").agg(F.min(F.when(F.col("upto") > F.col("left"), F.col("at"))).alias("stop"), F.coalesce(F.max(F.when(F.col("upto") <= F.col("left"), F.col("upto"))), F.lit(0)).alias("used"))
        run = stored.save(run.join(ends, "g").withColumn("fits", F.col("stop").isNull() | (F.col("at") < F.col("stop"))), f"run-{n}")
        taken.append(run.where("fits").select("g", "o"))
        rest = run.where("not fits").select("g", "o", "size", (F.col("left") - F.col("used")).alias("left")).where("size <= left")
        rows = stored.save(rows.join(hot.select("g"), "g", "left_anti").unionByName(rest), f"rest-{n}")
        n += 1

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        left, keep = int(pdf["left"].iloc[0]), []
        for x in (pdf := pdf.sort_values("o", kind="stable"))["size"]:
            keep.append(x <= left)
            left -= x if keep[-1] else 0
        return pdf[keep][["g", "o"]]

    kept = rows.groupBy("g").applyInPandas(fold, f"g {fields[group]}, o {fields[order]}")
    for one in taken:
        kept = kept.unionByName(one)
    return documents.join(kept.select(F.col("g").alias(group), F.col("o").alias(order)), [group, order], "left_semi")


def list_prefix(documents: DataFrame, prefix: str = "") -> DataFrame:
    """Entries right below a path prefix: (entry, is_dir, n_documents)."""
    rest = F.expr(f"substring(path, {len(prefix) + 1})")
    entry = F.element_at(F.split(rest, "/"), 1)
    rows = documents.where(F.col("path").startswith(prefix)).select(entry.alias("entry"), F.contains(rest, F.lit("/")).alias("is_dir"))
    return rows.groupBy("entry", "is_dir").agg(F.count("*").alias("n_documents"))


def path_tree(documents: DataFrame) -> DataFrame:
    """(level, folder, n_documents): every folder of the documents' paths, with all documents below it; level 1 is the top."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.struct(n.alias("level"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("folder")))
    rows = documents.select(F.explode(F.when(F.size(parts) > 1, above)).alias("x"))
    return rows.groupBy("x.level", "x.folder").agg(F.count("*").alias("n_documents"))


def list_collections(collections: DataFrame, enabled: bool = False) -> DataFrame:
    """In order of names; only those that a search covers by default, if ``enabled``."""
    return (collections.where("include_by_default") if enabled else collections).orderBy("name")


def list_documents(documents: DataFrame, collection_id: str) -> DataFrame:
    """A collection's documents in order of file names."""
    return documents.where(F.col("collection_id") == collection_id).orderBy("filename", "document_id")


def list_chunks(chunks: DataFrame, document_id) -> DataFrame:
    return chunks.where(F.col("document_id") == document_id).orderBy("sequence")


def list_contexts(contexts: DataFrame, context_type: str | None = None, target_id: str | None = None) -> DataFrame:
    """In order of type and target; only those of a type or a target, if given."""
    if context_type is not None:
        if context_type not in CONTEXT_TYPES:
            raise ValueError(f"unknown context type {context_type}")
        contexts = contexts.where(F.col("context_type") == context_type)
    if target_id is not None:
        contexts = contexts.where(F.col("target_id") == target_id)
    return contexts.orderBy("context_type", "target_id", "context_id")


def remove_context(contexts: DataFrame, context_id: str) -> DataFrame:
    return contexts.where(F.col("context_id") != context_id)


# status and maintenance


def status(tables: dict[str, DataFrame]) -> DataFrame:
    """(metric, value): rows of every table and the documents' bytes."""
    out = [df.agg(F.count("*").alias("value")).select(F.lit(f"n_{k}").alias("metric"), "value") for k, df in tables.items()]
    out.append(tables["documents"].agg(F.coalesce(F.sum("file_size"), F.lit(0)).alias("value")).select(F.lit("total_bytes").alias("metric"), "value"))
    res = out[0]
    for x in out[1:]:
        res = res.unionByName(x)
    return res


def collection_counts(collections: DataFrame, documents: DataFrame) -> DataFrame:
    n = documents.groupBy("collection_id").agg(F.count("*").alias("n"), F.sum("file_size").alias("b"))
    return collections.join(n, "collection_id", "left").select("collection_id", F.coalesce("n", F.lit(0)).alias("document_count"), F.coalesce("b", F.lit(0)).alias("total_bytes"))


def chunk_counts(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    n = chunks.groupBy("document_id").agg(F.count("*").alias("n"))
    return documents.join(n, "document_id", "left").groupBy("collection_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("chunk_count"))


def index_diff(files: DataFrame, existing: DataFrame, force: bool = False) -> DataFrame:
    """(path, status): new, changed, unchanged or removed, by checksum of the full text."""
    f = files.select("path", F.col("checksum").alias("new_sum"))
    e = existing.select("path", F.col("checksum").alias("old_sum"))
    kind = F.when(F.col("old_sum").isNull(), "new").when(F.col("new_sum").isNull(), "removed")
    kind = kind.when((F.col("new_sum") == F.col("old_sum")) & F.lit(not force), "unchanged").otherwise("changed")
    return f.join(e, "path", "full_outer").select("path", kind.alias("status"))


def index_report(diff: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """One row: files processed, added, updated, skipped, failed. ``failed`` (path, error): files that could not be read."""
    n = lambda *s: F.count(F.when(F.col("status").isin(*s), 1))
    rows = diff if failed is None else diff.join(failed.select("path"), "path", "left_anti").unionByName(failed.select("path", F.lit("failed").alias("status")))
    return rows.agg(n("new", "changed", "unchanged").alias("processed"), n("new").alias("added"), n("changed").alias("updated"), n("unchanged").alias("skipped"), n("failed").alias("failed"))


def index_apply(files: DataFrame, existing: DataFrame, force: bool = False) -> DataFrame:
    """The next snapshot of a collection's documents; unchanged rows stay as they are."""
    diff = index_diff(files, existing, force)
    stay = existing.join(diff.where("status = 'unchanged'"), "path", "left_semi")
    return stay.unionByName(files.join(diff.where("status in ('new', 'changed')"), "path", "left_semi"), allowMissingColumns=True)


def refresh_postings(old: DataFrame, diff: DataFrame, documents: DataFrame, postings) -> DataFrame:
    """Postings (path, ...) after a diff: only new and changed documents are tokenised. Touched paths are few beside postings and texts,
    so they are hashed, and neither postings nor texts are sorted for the joins."""
    touched = diff.where("status <> 'unchanged'").select("path").hint("shuffle_hash")
    return old.join(touched, "path", "left_anti").unionByName(postings(documents.join(touched, "path", "left_semi")))


def orphans(rows: DataFrame, documents: DataFrame, key: str = "document_id") -> DataFrame:
    return rows.join(documents.select(F.col("document_id").alias(key)).distinct(), key, "left_anti")


def without_orphans(rows: DataFrame, documents: DataFrame, key: str = "document_id") -> DataFrame:
    return rows.join(documents.select(F.col("document_id").alias(key)).distinct(), key, "left_semi")


def cleanup(tables: dict[str, DataFrame], now: datetime | Column) -> tuple[dict[str, DataFrame], DataFrame]:
    """(the tables without orphaned chunks and embeddings and without expired cache entries, a row with how many of each go)."""
    out, gone = dict(tables), []
    for name in ("chunks", "embeddings"):
        if name in tables:
            out[name] = without_orphans(tables[name], tables["documents"])
            gone.append((name, orphans(tables[name], tables["documents"])))
    if "llm_cache" in tables:
        out["llm_cache"] = live(tables["llm_cache"], now)
        gone.append(("llm_cache", expired(tables["llm_cache"], now)))
    report = None
    for name, rows in gone:
        one = rows.agg(F.count("*").alias(f"{name}_removed"))
        report = one if report is None else report.crossJoin(one)  # one row each
    return out, report


def prune_contexts(contexts: DataFrame, documents: DataFrame) -> DataFrame:
    """Contexts without those of paths that no document has."""
    gone = contexts.where("context_type = 'path'").join(documents.select(F.col("path").alias("target_id")).distinct(), "target_id", "left_anti").select("context_id")
    return contexts.join(gone, "context_id", "left_anti")


def concat_contexts(contexts: DataFrame) -> DataFrame:
    """(target_id, text): a target's contexts in order of type and id, joined by blank lines."""
    text = F.concat_ws("\n\n", F.transform(F.array_sort(F.collect_list(F.struct("context_type", "context_id", "content"))), lambda x: x["content"]))
    return contexts.groupBy("target_id").agg(text.alias("text"))


def build_context(contexts: DataFrame, requests: DataFrame) -> DataFrame:
    """(query_id, text) of requests (query_id, collection_ids, path_prefixes): all global contexts, then those of the collections in the
    order asked, then those of paths below any of the prefixes, joined by blank lines; '' without any.

    Contexts of a part stand by target and id. A path meets its prefixes by equality of heads of the lengths that prefixes have, once
    however many of a request's prefixes hold it; an empty prefix holds every path. Null lists ask nothing.
    """
    kind = lambda k: contexts.where(F.col("context_type") == k).select("target_id", "context_id", "content")
    part = lambda rows, p, place: rows.select("query_id", F.struct(F.lit(p).alias("part"), place.alias("place"), "target_id", "context_id", "content").alias("c"))
    ids = requests.select("query_id").distinct()
    asked = requests.select("query_id", F.posexplode("collection_ids").alias("place", "target_id"))
    found = part(ids.crossJoin(kind("global")), 0, F.lit(0))  # every request has all of them
    found = found.unionByName(part(asked.join(kind("collection"), "target_id"), 1, F.col("place")))
    heads = requests.select("query_id", F.explode("path_prefixes").alias("head")).distinct().withColumn("size", F.length("head"))
    sizes = heads.agg(F.array_sort(F.collect_set("size")).alias("sizes"))  # one row: the lengths that occur
    paths = kind("path").crossJoin(sizes).withColumn("size", F.explode(F.filter("sizes", lambda s: s <= F.length("target_id"))))
    below = paths.withColumn("head", F.expr("substring(target_id, 1, size)")).join(heads, ["head", "size"]).select("query_id", "target_id", "context_id", "content").distinct()
    found = found.unionByName(part(below, 2, F.lit(0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: c["content"]), "\n\n")
    return ids.join(found, "query_id", "left").groupBy("query_id").agg(text.alias("text"))


def migrate_path_contexts(old: DataFrame, contexts: DataFrame) -> DataFrame:
    """The contexts with those of the legacy table (id, path, context, times) as path contexts."""
    rows = old.select(F.col("id").alias("context_id"), F.col("path").alias("target_id"), F.lit("path").alias("context_type"), F.col("context").alias("content"), "created_at", "updated_at")
    return contexts.unionByName(rows.join(contexts.select("context_id"), "context_id", "left_anti"))


def live(cache: DataFrame, now: datetime | Column) -> DataFrame:
    """Entries that have not run out."""
    return cache.where(F.col("expires_at").isNull() | (F.col("expires_at") > (now if isinstance(now, Column) else F.lit(now))))


def cache_get(cache: DataFrame, prompts: DataFrame, now: datetime | Column) -> DataFrame:
    """(model_name, prompt, response): null where the cache has no live entry."""
    keyed = prompts.withColumn("prompt_hash", F.sha2("prompt", 256))
    return keyed.join(live(cache, now).select("model_name", "prompt_hash", "response"), ["model_name", "prompt_hash"], "left")


def cache_set(cache: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("model_name", "prompt_hash")) -> DataFrame:
    """The next snapshot of a cache: new entries replace those of the same key."""
    return upsert(cache, new, list(keys))


def expired(cache: DataFrame, now: datetime | Column) -> DataFrame:
    """Entries that have run out, which ``live`` leaves behind."""
    return cache.where(F.col("expires_at") <= (now if isinstance(now, Column) else F.lit(now)))


def cache_clear(cache: DataFrame, model_id: str | None = None) -> DataFrame:
    """Without the entries of a model, or of any."""
    return cache.where(F.lit(False)) if model_id is None else cache.where(F.col("model_id") != model_id)


def cache_split(rows: DataFrame, cache: DataFrame, model_id: str, text: str = "content") -> tuple[DataFrame, DataFrame]:
    """(hits with their embedding, misses) of an embedding cache keyed by (content hash, model)."""
    keyed = rows.withColumn("content_hash", F.sha2(text, 256))
    own = cache.where(F.col("model_id") == model_id).select("content_hash", "embedding")
    return keyed.join(own, "content_hash"), keyed.join(own, "content_hash", "left_anti")


def cache_stats(cache: DataFrame) -> DataFrame:
    return cache.groupBy("model_id").agg(F.count("*").alias("entries"))
