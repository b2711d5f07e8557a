"""Language of a text by hierarchical discrimination: the family first, then languages within it.

Families are told apart, and languages within each family, by linear support vector machines, one for every two classes (one against
one). Features are hashed n-grams of 2 to 4 bytes over folded letters, as shares of a text's n-grams, so a whole text's margin is a
sum over its places and long texts need no more memory than short ones. A margin becomes a probability by a logistic curve that is
fitted on documents which the machines have not seen; a class's probability multiplies those of its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.textvec import buffer_of, slices

#: Families of languages by ISO 639-1 code. A language of none of them is a family of its own.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"],
    "romance": ["ca", "es", "fr", "gl", "it", "oc", "pt", "ro"],
    "slavic": ["be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "baltic": ["lt", "lv"],
    "celtic": ["br", "cy", "ga", "gd"],
    "uralic": ["et", "fi", "hu"],
    "turkic": ["az", "kk", "ky", "tr", "tt", "uz"],
    "indo-aryan": ["bn", "gu", "hi", "mr", "ne", "pa", "si", "ur"],
    "semitic": ["ar", "am", "he", "mt"],
}
#: Bits of a hashed n-gram of each size, and the sizes.
BITS, SIZES = 15, (2, 3, 4)
CELLS = len(SIZES) << BITS
#: Documents learned from, of each language.
PER_LANGUAGE = 1000
#: A text's shares are small; this brings a typical text to unit length.
SCALE = 12.0
GAP = max(SIZES) - 1
#: Places of texts that are looked up at once.
STRETCH = 1 << 19
UNKNOWN = "und"
_LETTER = np.zeros(256, dtype=np.uint8) + 32
_LETTER[97:123], _LETTER[65:91], _LETTER[128:] = np.arange(97, 123), np.arange(97, 123), np.arange(128, 256)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: a quarter, by the crc32 of its id as text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def _grams(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, feature) of every n-gram with a letter; letters are a-z and all bytes beyond ASCII, every other byte is a gap. Gaps
    before and after a text are part of it."""
    data, off = buffer_of(texts)
    n = len(off) - 1
    at = np.repeat(off, GAP)
    flat = np.insert(_LETTER[data], at, np.full(len(at), 32, dtype=np.uint8))
    begin = off[:-1] + np.arange(n) * GAP
    for a in range(0, len(flat) - GAP, STRETCH):
        part = flat[a : min(len(flat), a + STRETCH + GAP)]
        places = min(STRETCH, len(flat) - GAP - a)
        text = np.searchsorted(begin, np.arange(a, a + places), "right") - 1 if n > 1 else np.zeros(places, dtype=np.int64)
        x, some = part[:places].astype(np.uint32), part[:places] != 32
        for i in range(1, max(SIZES)):
            nxt = part[i : i + places]
            x, some = x << np.uint32(8) | nxt, some | (nxt != 32)
            if i + 1 in SIZES:
                k = SIZES.index(i + 1)
                cell = (x * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS)).astype(np.int64) + (k << BITS)
                yield text[some], cell[some]


@dataclass(frozen=True)
class Model:
    """``labels`` in order; ``families``: each the places of its labels; a column of ``weights`` for each machine, the families'
    first. ``pairs``: what each machine tells apart: (family or -1 for families, first class, second class); ``curve``: slope and
    offset of its probability of the first."""

    labels: list[str]
    families: list[list[int]]
    pairs: list[tuple[int, int, int]]
    weights: np.ndarray
    bias: np.ndarray
    curve: np.ndarray

    def classes(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the label, probability) of each row of margins."""
        p = 1 / (1 + np.exp(-np.clip(margins * self.curve[:, 0] + self.curve[:, 1], -30, 30)))
        family, sure = self._among(p, -1, len(self.families))
        label, prob = np.zeros(len(p), dtype=np.int64), sure.copy()
        for f, members in enumerate(self.families):
            at = np.flatnonzero(family == f)
            which, q = self._among(p[at], f, len(members))
            label[at] = np.array(members)[which]
            prob[at] *= q
        return label, prob

    def _among(self, p: np.ndarray, group: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The class that its pairs favour most, and its share of all classes' products of pair probabilities."""
        total = np.zeros((len(p), n))
        for k, (g, a, b) in enumerate(self.pairs):
            if g == group:
                total[:, a] += np.log(p[:, k])
                total[:, b] += np.log1p(-p[:, k])
        share = np.exp(total - total.max(axis=1, keepdims=True)) if len(p) else total
        best = share.argmax(axis=1) if len(p) else np.zeros(0, dtype=np.int64)
        return best, share[np.arange(len(p)), best] / share.sum(axis=1)


def _svm(rows: list[tuple[np.ndarray, np.ndarray]], sign: np.ndarray, cost: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss, by coordinate descent on its dual; the bias is a weight of the constant 1."""
    w, bias, alpha = np.zeros(CELLS), 0.0, np.zeros(len(rows))
    square = np.array([float(v @ v) + 1 for _, v in rows])
    rng = np.random.default_rng(7)
    for _ in range(rounds):
        for i in rng.permutation(len(rows)):
            at, v = rows[i]
            slack = 1 / (2 * cost[i])
            slope = sign[i] * (float(w[at] @ v) + bias) - 1 + slack * alpha[i]
            new = max(alpha[i] - slope / (square[i] + slack), 0.0)
            step, alpha[i] = (new - alpha[i]) * sign[i], new
            if step:
                w[at] += step * v
                bias += step
    return w, bias


def _curve(margin: np.ndarray, first: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton's steps on smoothed targets; 1, 0 where a class has no document."""
    n1, n0 = int(first.sum()), int((~first).sum())
    if not n1 or not n0:
        return 1.0, 0.0
    y = np.where(first, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, beta = np.column_stack([margin, np.ones(len(margin))]), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, x.T @ (y - p) - 1e-6 * beta)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(beta[0], 1e-3)), float(beta[1])


def fit(labels: list[str], rows: list[tuple[np.ndarray, np.ndarray]], families: dict[str, list[str]] | None = None, cost: float = 4.0) -> Model:
    """From features (cells, shares) and labels of a bounded sample, in a fixed order. Every fifth document of a label fits the curves
    and not the machines."""
    names = sorted(set(labels))
    of = {code: family for family, codes in (FAMILIES if families is None else families).items() for code in codes}
    groups: dict[str, list[int]] = {}
    for i, name in enumerate(names):
        groups.setdefault(of.get(name, f"only {name}"), []).append(i)
    members = [groups[k] for k in sorted(groups)]
    family = np.zeros(len(names), dtype=np.int64)
    for f, every in enumerate(members):
        family[every] = f
    label = np.array([names.index(x) for x in labels])
    nth, seen = np.zeros(len(label), dtype=np.int64), np.zeros(len(names), dtype=np.int64)
    for i, x in enumerate(label.tolist()):
        nth[i], seen[x] = seen[x], seen[x] + 1
    apart = nth % 5 == 4
    pairs = [(-1, a, b) for a, b in combinations(range(len(members)), 2)]
    pairs += [(f, a, b) for f, every in enumerate(members) for a, b in combinations(range(len(every)), 2)]
    weights, bias, curve = np.zeros((CELLS, len(pairs)), dtype=np.float32), np.zeros(len(pairs)), np.zeros((len(pairs), 2))
    for k, (g, a, b) in enumerate(pairs):
        kind = family[label] if g < 0 else label
        one, two = (a, b) if g < 0 else (members[g][a], members[g][b])
        at = np.flatnonzero((kind == one) | (kind == two))
        learn, first = at[~apart[at]], kind[at[~apart[at]]] == one
        balance = np.where(first, len(first) / max(1, 2 * first.sum()), len(first) / max(1, 2 * (~first).sum()))
        w, bias[k] = _svm([rows[i] for i in learn], np.where(first, 1.0, -1.0), cost * balance)
        weights[:, k] = w
        rest = at[apart[at]]
        margin = np.array([float(w[rows[i][0]] @ rows[i][1]) + bias[k] for i in rest])
        curve[k] = _curve(margin, kind[rest] == one)
    return Model(names, members, pairs, weights, bias, curve)


def _sample(documents: DataFrame, per_language: int) -> DataFrame:
    """About ``per_language`` learnable documents of each language, at a rate of its own, by a hash of the id."""
    known = documents.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = known.groupBy("lang").count().collect()  # a row for each language; the model has a machine for every two
    if not sizes:
        return known.where(F.lit(False))
    rate = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], per_language / r["count"])])
    return known.where(F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1 << 30)) < F.element_at(rate, F.col("lang")) * (1 << 30))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, texts in slices(batch.column(2)):
            key, count = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
            for text, cell in _grams(texts):
                k, c = np.unique(text * CELLS + cell, return_counts=True)
                key, back = np.unique(np.concatenate([key, k]), return_inverse=True)
                count = np.bincount(back, weights=np.concatenate([count, c])).astype(np.int64)
            ends = np.searchsorted(key, np.arange(len(texts) + 1) * CELLS)
            cells = [pa.scalar((key[a:b] % CELLS).astype("<u4").tobytes()) for a, b in zip(ends, ends[1:], strict=False)]
            counts = [pa.scalar(count[a:b].astype("<u4").tobytes()) for a, b in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), batch.column(1).slice(first, len(texts)), pa.array([x.as_py() for x in cells], pa.binary()), pa.array([x.as_py() for x in counts], pa.binary())], ["order", "lang", "cells", "counts"])


def train(documents: DataFrame, per_language: int = PER_LANGUAGE, families: dict[str, list[str]] | None = None) -> Model | None:
    """A model of text and ``lang`` of documents that are not held out; None without one that has a letter."""
    sample = _sample(documents, per_language).select(F.xxhash64("doc_id", "text").alias("order"), F.col("lang").cast("string").alias("lang"), "text")
    got = sample.mapInArrow(_rows, "order long, lang string, cells binary, counts binary").toArrow().to_pylist()  # bounded: per_language each
    got = sorted((r for r in got if r["cells"]), key=lambda r: (r["order"], r["lang"]))
    rows = []
    for r in got:
        count = np.frombuffer(r["counts"], dtype="<u4").astype(np.float64)
        rows.append((np.frombuffer(r["cells"], dtype="<u4").astype(np.int64), count * (SCALE / count.sum())))
    return fit([r["lang"] for r in got], rows, families) if got else None


def predict(spark: SparkSession, documents: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every whole text."""
    shared = spark.sparkContext.broadcast(model)  # of a size that hangs on the languages alone

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for first, texts in slices(batch.column(2)):
                n = len(texts)
                lettered = np.array([x is not None and (x.isascii() or any(map(str.isalpha, x))) for x in texts.to_pylist()], dtype=bool)
                names, score = [UNKNOWN] * n, np.zeros(n)
                if m is not None:
                    total, places = np.zeros((n, len(m.pairs))), np.zeros(n)
                    for text, cell in _grams(texts):
                        places += np.bincount(text, minlength=n)
                        for k in range(len(m.pairs)):
                            total[:, k] += np.bincount(text, weights=m.weights[cell, k], minlength=n)
                    label, prob = m.classes(total * (SCALE / np.maximum(places, 1))[:, None] + m.bias)
                    for i in np.flatnonzero(lettered & (places > 0)).tolist():
                        names[i], score[i] = m.labels[label[i]], prob[i]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), batch.column(1).slice(first, n), pa.array(names), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def identify(spark: SparkSession, documents: DataFrame, per_language: int = PER_LANGUAGE, families: dict[str, list[str]] | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document; learned from ``lang`` and texts of those that are not held out.

    At most about ``per_language`` documents of each language are learned from; every whole text is predicted. A text that is null or
    has no letter is ``und`` with score 0, and so is every text if nothing could be learned. One learned language has score 1. A null
    doc_id counts as empty text and is not held out; repeated rows are predicted alike. Other columns are not read.
    """
    docs = documents.select("doc_id", "text", "lang")
    return predict(spark, docs.select("doc_id", "text"), train(docs, per_language, families))
