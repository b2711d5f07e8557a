"""Snippets around the best sentence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import text as T

MOST = 300


def sentence_score(sentence: Column, terms: Column) -> Column:
    """Sum over terms of occurrences times length, any case."""
    low = F.lower(sentence)
    return F.aggregate(terms, F.lit(0), lambda acc, t: acc + F.length(low) - F.length(F.replace(low, F.lower(t), F.lit(""))))


def best_sentence(rows: DataFrame, key: str = "document_id") -> DataFrame:
    """Rows (key, content, terms) to (key, sentence_idx, sentence, score): the first of the best."""
    every = rows.select(key, "terms", F.posexplode(T.sentences(F.col("content"))).alias("sentence_idx", "sentence"))
    every = every.withColumn("score", sentence_score(F.col("sentence"), F.col("terms")))
    w = Window.partitionBy(key).orderBy(F.desc("score"), "sentence_idx")
    return every.withColumn("nth", F.row_number().over(w)).where("nth = 1").select(key, "sentence_idx", "sentence", "score")


def _let(value: Column, then) -> Column:
    """``then(value)`` with value computed once, however often ``then`` uses it inside lambdas."""
    return F.get(F.transform(F.array(value), lambda x: then(x)), F.lit(0))


def snippets(content: Column, terms: Column, most: int = MOST) -> Column:
    """The best sentence and what stands around it, sentence by sentence to the left and to the right in turn, while ``most``
    characters hold it; the beginning of a text without a term, or of one sentence. Ellipses mark cuts.

    The window is a fold over the places of two borders; the lengths of sentences are computed once. A null text is empty, a null or
    empty term nowhere.
    """
    cut = lambda t: F.when(F.length(t) <= most, t).otherwise(F.concat(F.substring(t, 1, most - 3), F.lit("...")))
    words = F.filter(F.coalesce(terms, F.array().cast("array<string>")), lambda t: t.isNotNull() & (t != ""))
    text = F.coalesce(content, F.lit(""))

    def grown(p: Column) -> Column:
        n = F.size(p["parts"])
        first = (F.array_position(p["scores"], F.array_max(p["scores"])) - 1).cast("int")
        start = F.struct(first.alias("lo"), first.alias("hi"), F.get(p["lens"], first).alias("size"))

        def step(acc: Column, _: Column) -> Column:
            left = F.get(p["lens"], acc["lo"] - 1) + 1
            more = (acc["lo"] > 0) & (acc["size"] + left <= most)
            size = acc["size"] + F.when(more, left).otherwise(0)
            right = F.get(p["lens"], acc["hi"] + 1) + 1
            on = (acc["hi"] + 1 < n) & (size + right <= most)
            return F.struct(F.when(more, acc["lo"] - 1).otherwise(acc["lo"]).alias("lo"), F.when(on, acc["hi"] + 1).otherwise(acc["hi"]).alias("hi"), (size + F.when(on, right).otherwise(0)).alias("size"))

        # every sentence between the borders takes a character at least, so no more steps than characters are of use
        window = F.aggregate(F.sequence(F.lit(1), F.least(n, F.lit(max(1, most)))), start, step)
        dots = lambda there: F.when(there, "...").otherwise("")
        shown = lambda w: F.concat(dots(w["lo"] > 0), cut(F.array_join(F.slice(p["parts"], w["lo"] + 1, w["hi"] - w["lo"] + 1), " ")), dots(w["hi"] + 1 < n))
        return F.when((n <= 1) | (F.array_max(p["scores"]) == 0), cut(text)).otherwise(_let(window, shown))

    scored = lambda parts: F.struct(parts.alias("parts"), F.transform(parts, lambda s: F.length(s)).alias("lens"), F.transform(parts, lambda s: sentence_score(s, words)).alias("scores"))
    return _let(_let(T.sentences(text), scored), grown)
