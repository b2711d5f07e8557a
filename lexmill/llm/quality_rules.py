"""Quality rules whose cutoffs are risk-controlled.

Each rule is a number that is high for bad texts. A stratum is a language. The labelled good documents of a stratum are dealt into
a fitting part (one in ``FITTING`` by a hash of the id) and a holdout. The fitting part proposes a ladder of ``LEVELS`` sets of
cutoffs, one for each rule, from far above its own highest values (``LOOSE``) down to them and on to stricter ones, each set
rejecting all that the sets before it reject. The holdout judges the sets in this order, by an exact binomial (Clopper-Pearson) upper bound of the share of good documents
that all rules together reject; the first set whose bound exceeds ``FALSE_REJECTION`` ends the sequence, and the last one that
held is used. Testing in a fixed order costs no correction for the number of sets; over strata the confidence is Bonferroni-corrected.

A stratum is tested only if its holdout is large enough to show anything (none rejected gives a bound within the allowed share, at
the confidence that the number of tested strata leaves); all others, rare languages among them, are judged by the base rule alone.
No stratum is ever judged by the cutoffs of another or of a pool, so the bound holds for each of them.

Edge cases: a null text has no words and fails the base rule, as every text under 50 words; a null language is the language "";
repeated labels count once per document, as good only if all agree; null labels are left out; equal rows of a labelled document
count once in a fit, and all are judged; extra columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.scratch import Scratch
from lexmill.llm.textvec import SPACE, grams, slices, words

#: Share of good documents that all rules together may reject in a stratum, and the chance of being wrong about any of it.
FALSE_REJECTION, MISTAKE = 0.02, 0.05
#: Bins of a rule's values; one labelled document in this many proposes cutoffs.
GRID, FITTING = 200, 4
#: Bins above the fitting part's highest, for the loosest levels; levels within its values; share rejected by the strictest of them.
LOOSE, FITTED, STRICTEST = (100, 80, 60, 50, 40, 30, 25, 20, 16, 12, 10, 8, 6, 5, 4, 3, 2, 1), 40, 0.1
LEVELS = len(LOOSE) + FITTED
RULES = ["symbols", "dup_lines", "repeats", "capitals", "short_words"]
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_CAPITAL = np.zeros(256, dtype=bool)
_CAPITAL[65:91] = True


def repeat_words(g: np.ndarray, n_words: int) -> int:
    """Words that lie in a 3-word window found twice or more. ``g``: the windows' hashes in order."""
    if len(g) < 2:
        return 0
    s = np.sort(g)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return 0
    hit = np.isin(g, twice)
    cover = np.zeros(n_words, dtype=bool)
    for j in range(3):
        cover[j : j + len(g)] |= hit
    return int(cover.sum())


def _lines(raw: bytes) -> tuple[int, int]:
    """Lines with a word, and those equal to an earlier one."""
    if b"\n" not in raw:
        return (1, 0) if raw.strip() else (0, 0)
    found = [x for x in raw.split(b"\n") if x.strip()]
    return len(found), len(found) - len(set(found))


def _measure(batches):
    for batch in batches:
        for a, texts in slices(batch.column("text")):
            w = words(texts, fold=False)
            off = np.concatenate(([0], np.cumsum(np.diff(_offsets(texts)))))
            count = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask)))[off])  # noqa: B023, E731
            space = SPACE[w.data]
            chars = count(~space & ((w.data & 0xC0) != 0x80))
            symbols, capitals = count(_SYMBOL[w.data]), count(_CAPITAL[w.data])
            n = np.diff(w.first)
            g = grams(w, 3)
            raw = w.data.tobytes()
            repeats, lines = [], []
            for x, y, p, q in zip(w.first[:-1].tolist(), w.first[1:].tolist(), off[:-1].tolist(), off[1:].tolist(), strict=True):
                repeats.append(repeat_words(g[x : y - 2] if y - x >= 3 else g[:0], y - x))
                lines.append(_lines(raw[p:q]))
            cols = [n, chars, symbols, [d for _, d in lines], repeats, [m for m, _ in lines], capitals]
            part = batch.slice(a, len(texts))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("lang"), *[pa.array(c, pa.int64()) for c in cols]],
                names=["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals"],
            )


def _offsets(texts: pa.Array) -> np.ndarray:
    from lexmill.llm.textvec import buffer_of

    return buffer_of(texts)[1]


MEASURES = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_capitals long"


def measures(documents: DataFrame) -> DataFrame:
    """Counts of every whole text."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_measure, MEASURES)


def _rule_columns() -> dict[str, F.Column]:
    per = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    mean = F.coalesce(F.try_divide(F.col("word_chars"), F.col("n_words")), F.lit(0.0))
    return {
        "symbols": F.least(F.lit(1.0), per("n_symbols", "word_chars")),
        "dup_lines": per("n_dup_lines", "n_lines"),
        "repeats": per("n_repeat_words", "n_words"),
        "capitals": per("n_capitals", "word_chars"),
        "short_words": F.greatest(F.lit(0.0), 1 - mean / 6),
    }


def upper_bound(k: int, n: int, mistake: float) -> float:
    """Exact binomial upper confidence bound of a rate, given k of n."""
    if n == 0 or k >= n:
        return 1.0

    def below(p: float) -> float:  # P(X <= k)
        i = np.arange(k + 1)
        logs = np.array([math.lgamma(n + 1) - math.lgamma(x + 1) - math.lgamma(n - x + 1) for x in i]) + i * math.log(p) + (n - i) * math.log1p(-p)
        top = logs.max()
        return float(min(1.0, math.exp(top) * np.exp(logs - top).sum()))

    lo, hi = max(k / n, 1e-12), 1 - 1e-12
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if below(mid) <= mistake else (mid, hi)
    return hi


def tested(sizes: list[int]) -> int:
    """How many of the strata, by size of the holdout, largest first, can be tested so that each could show something."""
    for k in range(len(sizes), 0, -1):
        if upper_bound(0, sizes[k - 1], MISTAKE / k) <= FALSE_REJECTION:
            return k
    return 0


def ladder(bins: np.ndarray) -> np.ndarray:
    """Cutoffs (as bins) of one rule by level, loosest first. ``bins``: good fitting documents by bin (``GRID`` + 1).

    After the loose levels, level i rejects at most i / ``FITTED`` * ``STRICTEST`` of them; no level rejects a document of bin 0.
    """
    from_bin = np.append(np.cumsum(bins[::-1])[::-1], 0)  # documents at or above each bin
    allowed = np.arange(FITTED) / FITTED * STRICTEST * bins.sum()
    within = [int(np.flatnonzero(from_bin <= x)[0]) for x in allowed]
    return np.maximum(1, [min(GRID + 1, within[0] + x) for x in LOOSE] + within)


def last_safe(rejected: np.ndarray, n: int, mistake: float) -> int | None:
    """The last level before the first one that is not shown to be safe. ``rejected``: good holdout documents by level, ascending."""
    best, most = None, -1
    for level, k in enumerate(rejected.tolist()):
        if k > most:
            if upper_bound(k, n, mistake) > FALSE_REJECTION:
                break
            most = k
        best = level
    return best


def _bins() -> list[F.Column]:
    return [F.least(F.floor(v * GRID).cast("int"), F.lit(GRID)).alias(k) for k, v in _rule_columns().items()]


def fit_cutoffs(spark: SparkSession, measured: DataFrame, labels: DataFrame) -> dict[str, dict[str, int]]:
    """Cutoffs (as bins) by tested stratum and rule."""
    good = labels.where("quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("good")).where("good = 1")
    fitting = (F.pmod(F.xxhash64("doc_id"), F.lit(FITTING)) == 0).alias("fitting")
    rows = measured.where(~_base_failed()).join(good, "doc_id").select("doc_id", _stratum(), fitting, *_bins()).distinct()
    counted = rows.groupBy("stratum", "fitting").count().collect()  # a row or two for each language of the labels
    held = {r["stratum"]: r["count"] for r in counted if not r["fitting"]}
    strata = sorted(held, key=lambda s: (-held[s], s))
    strata = strata[: tested([held[s] for s in strata])]
    if not strata:
        return {}
    chosen = spark.createDataFrame([(s,) for s in strata], "stratum string")
    rows = rows.join(F.broadcast(chosen), "stratum")
    long = rows.where("fitting").select("stratum", F.explode(F.create_map(*[x for k in RULES for x in (F.lit(k), F.col(k))])).alias("rule", "bin"))
    bins = {(s, k): np.zeros(GRID + 1, dtype=np.int64) for s in strata for k in RULES}
    for r in long.groupBy("stratum", "rule", "bin").count().collect():  # strata x rules x grid at most
        bins[r["stratum"], r["rule"]][r["bin"]] += r["count"]
    steps = {k: ladder(v) for k, v in bins.items()}
    # the level that first rejects a document, by bin
    first = [(s, *[np.searchsorted(-steps[s, k], -np.arange(GRID + 1), side="left").tolist() for k in RULES]) for s in strata]
    table = spark.createDataFrame(first, "stratum string, " + ", ".join(f"first_{k} array<int>" for k in RULES))
    level = F.least(*[F.col(f"first_{k}")[F.col(k)] for k in RULES]).alias("level")
    at = {s: np.zeros(LEVELS + 1, dtype=np.int64) for s in strata}
    for r in rows.where("not fitting").join(F.broadcast(table), "stratum").select("stratum", level).groupBy("stratum", "level").count().collect():  # strata x levels
        at[r["stratum"]][r["level"]] += r["count"]
    out = {}
    for s in strata:
        i = last_safe(np.cumsum(at[s][:LEVELS]), held[s], MISTAKE / len(strata))
        if i is not None:
            out[s] = {k: int(steps[s, k][i]) for k in RULES}
    return out


def _stratum() -> F.Column:
    return F.coalesce(F.col("lang"), F.lit("")).alias("stratum")


def _base_failed() -> F.Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def quality_rules(spark: SparkSession, documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, counts, base_failed, kept, and the rule that rejected first."""
    measured = Scratch(spark, "rules").save(measures(documents), "measures")
    cutoffs = fit_cutoffs(spark, measured, labels)
    table = spark.createDataFrame([(s, *[c[k] for k in RULES]) for s, c in cutoffs.items()], "stratum string, " + ", ".join(f"cut_{k} int" for k in RULES))
    verdict = F.when(_base_failed(), F.lit("base"))
    for k, b in zip(RULES, _bins(), strict=True):
        verdict = verdict.when(b >= F.col(f"cut_{k}"), F.lit(k))
    rows = measured.withColumn("stratum", _stratum()).join(F.broadcast(table), "stratum", "left")
    rows = rows.withColumn("base_failed", _base_failed()).withColumn("rejected_by", verdict)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("rejected_by").isNull().alias("kept"), "rejected_by")
