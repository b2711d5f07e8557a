"""Full-text ranking: postings, corpus statistics, BM25 over prefix phrases, highlights, contexts.

Shapes: documents (document_id, collection_id, path, title, content, ...), queries (query_id, query), postings (document_id,
token, tf). Query terms meet the vocabulary first, by equality of prefixes of the lengths that the terms have, and only the
matching tokens meet the postings: no token is compared with every term, and no side is broadcast by hint. By default terms and
tokens meet by their Porter stems without marks; only distinct tokens and terms are stemmed, never texts.

An ``IndexStore`` keeps what ranking needs, so that a text is tokenised once and not for every search.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import porter
from lexmill.functions import text as T
from lexmill.operators import posting_lists

K1, B, IDF_LEAST = 1.2, 0.75, 1e-6


def postings(documents: DataFrame, tokenizer=T.tokens, key: str = "document_id", content: str = "content") -> DataFrame:
    exploded = documents.select(key, F.explode(tokenizer(F.coalesce(F.col(content), F.lit("")))).alias("token"))
    return exploded.groupBy(key, "token").agg(F.count("*").alias("tf"))


def doc_lengths(documents: DataFrame, tokenizer=T.tokens, key: str = "document_id", content: str = "content") -> DataFrame:
    return documents.select(key, F.size(tokenizer(F.coalesce(F.col(content), F.lit("")))).cast("long").alias("len"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    return lengths.agg(F.count("*").alias("n_docs"), F.avg("len").alias("avgdl"), F.coalesce(F.sum("len"), F.lit(0)).alias("n_tokens"))


def term_df(post: DataFrame) -> DataFrame:
    return post.groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@dataclass(frozen=True)
class Index:
    """An open index: posting lists of each segment with its tombstones (or None), one row of statistics, what results show of a
    document, the name of the documents' id, and how many tokens it holds."""

    segments: list[tuple[DataFrame, DataFrame | None]]
    stats: DataFrame
    facts: DataFrame
    key: str = "document_id"
    tokens: int = 0

    def flat(self, matched=lambda rows: rows, *, names: tuple[str, ...] = ("token",)) -> DataFrame:
        """(*names, key, tf, len): a row for each posting of what ``matched`` leaves of each segment's lists."""
        out = None
        for rows, dead in self.segments:
            found = matched(rows.select("token", "stem", "docs")).select(*names, F.inline("docs"))
            found = found if dead is None else found.join(dead, "key", "left_anti")
            out = found if out is None else out.unionByName(found)
        return out

    @property
    def postings(self) -> DataFrame:
        return self.flat().select("token", F.col("key").alias(self.key), F.col("len").cast("long").alias("len"), F.col("tf").cast("long").alias("tf"))

    @property
    def vocabulary(self) -> DataFrame:
        """(token, df, cf, stem); without tombstones no posting is read for it."""
        if all(dead is None for _, dead in self.segments):
            every = None
            for rows, _ in self.segments:
                part = rows.select("token", "stem", "n", "cf")
                every = part if every is None else every.unionByName(part)
            return every.groupBy("token", "stem").agg(F.sum("n").alias("df"), F.sum("cf").alias("cf")).select("token", "df", "cf", "stem")
        return self.flat(names=("token", "stem")).groupBy("token", "stem").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).select("token", "df", "cf", "stem")


FACTS = ["document_id", "collection_id", "path", "title"]


def query_terms(queries: DataFrame, tokenizer=T.tokens) -> DataFrame:
    """(query_id, pos, term, n_terms); punctuation separates terms, a repeated term counts again."""
    rows = queries.select("query_id", tokenizer(F.coalesce(F.col("query"), F.lit(""))).alias("t"))
    return rows.select("query_id", F.posexplode("t").alias("pos", "term"), F.size("t").alias("n_terms"))


def matching_tokens(vocabulary: DataFrame, terms: DataFrame, stems: bool = False) -> DataFrame:
    """(term, token) for tokens that begin with the term; with ``stems``, whose stem begins with the term's."""
    forms = vocabulary if "stem" in vocabulary.columns else vocabulary.select("token").distinct()
    if stems and "stem" not in forms.columns:
        forms = forms.withColumn("stem", porter.stemmed("token"))
    return posting_lists.matches(forms, terms, stems).select("term", "token")


def term_matches(post: DataFrame, terms: DataFrame, key: str = "document_id", stems: bool = False) -> DataFrame:
    """(term, document, tf) of every distinct term: tf of all tokens that the prefix matches."""
    return matching_tokens(post, terms, stems).join(post, "token").groupBy("term", key).agg(F.sum("tf").alias("tf"))


def index_matches(index: Index, terms: DataFrame, stems: bool = False) -> DataFrame:
    """(term, document, tf, len) from an index's lists: those outside the terms' ranges are not read. One exchange deals the matches by
    document, into as many parts as the index needs; sums by term and by query stay in their part."""
    found = index.flat(lambda rows: posting_lists.matches(rows, terms, stems), names=("term",))
    found = found.repartition(posting_lists.parts(found.sparkSession, index.tokens, posting_lists.GROWN), "key")
    return found.groupBy("term", F.col("key").alias(index.key)).agg(F.sum("tf").alias("tf"), F.max("len").alias("len"))


def phrase_matches(post: DataFrame | Index, terms: DataFrame, key: str = "document_id", stems: bool = False) -> DataFrame:
    """(query_id, pos, n_terms, document, tf): a row for each document that a query's term matches."""
    found = index_matches(post, terms, stems).drop("len") if isinstance(post, Index) else term_matches(post, terms, key, stems)
    return terms.join(found, "term").select("query_id", "pos", "n_terms", *found.columns[1:])


def conjunctive(matches: DataFrame, key: str = "document_id") -> DataFrame:
    """Documents in which every term of the query matches."""
    return matches.groupBy("query_id", key, "n_terms").agg(F.count("*").alias("n")).where("n = n_terms").select("query_id", key)


def bm25(documents: DataFrame | None, queries: DataFrame, k1: float = K1, b: float = B, tokenizer=T.tokens, key: str = "document_id", content: str = "content", index: Index | None = None, stems: bool = True) -> DataFrame:
    """(query_id, document, bm25) of all documents that match every term. Statistics are those of the whole corpus.

    ``stems``: terms match by stem and without marks; else as they are written. A term is looked up and scored once, however many
    queries have it.
    """
    terms = query_terms(queries, tokenizer)
    local = posting_lists.few(terms)
    terms = terms if local is None else local
    small = (lambda rows: rows) if local is None else F.broadcast  # a few rows for each of a counted set of terms
    if index is None:
        post, lengths = postings(documents, tokenizer, key, content), doc_lengths(documents, tokenizer, key, content)
        m, stats = term_matches(post, terms, key, stems=stems).join(lengths, key), corpus_stats(lengths)
    else:
        m, stats = index_matches(index, terms, stems), index.stats
    # every match counts; reading the same columns lets Spark compute the matches once for both sides
    df = m.groupBy("term").agg(F.count_if(F.col("tf") + F.col("len") > 0).alias("df")).crossJoin(F.broadcast(stats))  # one row
    idf = F.greatest(F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(IDF_LEAST))
    asked = terms.groupBy("query_id", "n_terms", "term").agg(F.count("*").alias("times"))
    asked = asked.join(df.select("term", "avgdl", idf.alias("idf")), "term")
    part = F.col("times") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avgdl")))
    rows = m.join(small(asked), "term").groupBy("query_id", key, "n_terms").agg(F.sum(part).alias("bm25"), F.sum("times").alias("n"))
    return rows.where("n = n_terms").select("query_id", key, "bm25")


def display_score(raw: Column) -> Column:
    """1 / (1 + |rank|): falls as the match gets better; order by the raw score."""
    return 1 / (1 + F.abs(raw))


def ranked(rows: DataFrame, score: str, key: str = "document_id", limit: int = 10, offset: int = 0, descending: bool = True, partition: str = "query_id") -> DataFrame:
    """Rows ranked 1.. by score (9 places, ties by key), from ``offset`` on; the filter lets Spark keep only the top of each group."""
    by = F.round(F.col(score), 9)
    w = Window.partitionBy(partition).orderBy(by.desc() if descending else by.asc(), F.col(key))
    return rows.withColumn("rank", F.row_number().over(w)).where((F.col("rank") > offset) & (F.col("rank") <= offset + limit))


def bm25_search(documents: DataFrame, queries: DataFrame, limit: int = 10, offset: int = 0, collections: DataFrame | None = None, min_score: float | None = 0.0, index: Index | None = None, **how) -> DataFrame:
    """Top documents of each query with display score; ``min_score`` applies after the limit. ``collections``: only those.

    With ``index`` nothing of the documents is read but what the index holds.
    """
    # queries of the same terms are one query until the top is known
    tokenizer = how.get("tokenizer", T.tokens)
    asked = queries.select("query_id", F.array_join(tokenizer(F.coalesce(F.col("query"), F.lit(""))), " ").alias("query"))
    asked = asked.withColumn("first", F.min("query_id").over(Window.partitionBy("query")))
    scored = bm25(documents, asked.where("query_id = first").select("query_id", "query").distinct(), index=index, **how)
    facts = documents.select(*FACTS) if index is None else index.facts
    if collections is not None:
        facts = facts.join(collections.select("collection_id").distinct(), "collection_id", "left_semi").select(*FACTS)
        scored = scored.join(facts.select("document_id"), "document_id", "left_semi")
    top = ranked(scored, "bm25", limit=limit, offset=offset).withColumnRenamed("query_id", "first")
    top = asked.select("query_id", "first").join(top, "first").drop("first")
    out = top.join(facts, "document_id").withColumn("score", display_score(F.col("bm25")))
    return out if min_score is None else out.where(F.col("score") >= min_score)


def default_collections(collections: DataFrame, names: list[str] | None = None, every: bool = False) -> DataFrame:
    """The collections that a search covers: the named ones, else the enabled ones. No match means none."""
    if every:
        return collections
    return collections.where(F.col("name").isin(names)) if names else collections.where("include_by_default")


def holding(documents: DataFrame, texts: DataFrame, tokenizer=T.tokens) -> DataFrame:
    """(query_id, document_id): documents whose content holds a whole text of ``texts`` (query_id, text).

    The text's second to fourth token are whole tokens of any such document; documents with that gram are candidates, by equality, and
    only they are searched. A text of under three tokens has no token that is surely whole: it is searched in all documents.
    """
    t = texts.select("query_id", "text", tokenizer(F.coalesce(F.col("text"), F.lit(""))).alias("t")).withColumn("size", F.least(F.lit(3), F.size("t") - 2))
    asked = t.where("size > 0").select("query_id", "text", F.expr("array_join(slice(t, 2, size), ' ')").alias("gram"))
    own = documents.select("document_id", tokenizer(F.coalesce(F.col("content"), F.lit(""))).alias("t"))
    gram = lambda n: F.transform(F.sequence(F.lit(1), F.size("t") - n + 1), lambda i: F.array_join(F.slice("t", i, F.lit(n)), " "))
    sizes = [r["size"] for r in t.where("size > 0").select("size").distinct().collect()]  # three at most
    grams = [F.when(F.size("t") >= n, gram(n)).otherwise(F.array().cast("array<string>")) for n in sizes]
    bare = t.where("size <= 0 and text is not null").select("query_id", "text")
    found = [] if not bare.limit(1).count() else [documents.join(bare, F.contains(F.col("content"), F.col("text"))).select("query_id", "document_id")]
    if sizes:
        near = own.select("document_id", F.explode(F.array_distinct(F.concat(*grams))).alias("gram")).join(asked, "gram").select("query_id", "text", "document_id")
        found.append(near.join(documents.select("document_id", "content"), "document_id").where(F.contains(F.col("content"), F.col("text"))).select("query_id", "document_id"))
    return found[0] if len(found) == 1 else found[0].unionByName(found[1]) if found else t.select("query_id").where("false").join(documents.select("document_id").where("false"))


def highlights(chunks: DataFrame, results: DataFrame, terms: DataFrame, most: int = 3, around: int = 50, documents: DataFrame | None = None) -> DataFrame:
    """(query_id, document_id, sequence, highlight): for the first matching chunks the first term's surroundings.

    ``documents``: for a result without chunks, the first 1000 characters of its content stand for a chunk. Results are few beside
    chunks: only chunks of documents among the results go on, and texts are joined last.
    """
    if documents is not None:
        bare = documents.join(results.select("document_id").distinct(), "document_id", "left_semi").join(chunks.select("document_id").distinct(), "document_id", "left_anti")
        chunks = chunks.select("document_id", "sequence", "content").unionByName(bare.select("document_id", F.lit(0).alias("sequence"), F.substring("content", 1, 1000).alias("content")))
    t = terms.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "term"))).alias("t"))
    rows = results.select("query_id", "document_id").join(t, "query_id").join(chunks, "document_id")
    low = F.lower("content")
    hit = F.filter(F.transform("t", lambda x: F.struct(F.instr(low, x["term"]).alias("at"), F.length(x["term"]).alias("n"))), lambda x: x["at"] > 0)
    rows = rows.withColumn("hit", F.try_element_at(hit, F.lit(1))).where("hit is not null")
    w = Window.partitionBy("query_id", "document_id").orderBy("sequence")
    rows = rows.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= most)
    start = F.greatest(F.col("hit.at") - 1 - around, F.lit(0))
    end = F.least(F.col("hit.at") - 1 + F.col("hit.n") + around, F.length("content"))
    cut = F.trim(F.substring(F.col("content"), start + 1, end - start))
    text = F.concat(F.when(start > 0, "...").otherwise(""), cut, F.when(end < F.length("content"), "...").otherwise(""))
    return rows.select("query_id", "document_id", "sequence", text.alias("highlight"))


def attach_contexts(results: DataFrame, contexts: DataFrame) -> DataFrame:
    """Results with the latest path context of their path, if any; /private/tmp is /tmp."""
    real = lambda p: F.regexp_replace(p, "^/private/tmp", "/tmp")
    w = Window.partitionBy("real").orderBy(F.desc("updated_at"), F.desc("context_id"))
    last = contexts.where("context_type = 'path'").withColumn("real", real(F.col("target_id"))).withColumn("nth", F.row_number().over(w)).where("nth = 1")
    last = last.select("real", F.col("content").alias("context_description"))
    return results.withColumn("real", real(F.col("path"))).join(last, "real", "left").drop("real")
