"""Quality classifier by co-training of a text view and a metadata view.

Two logistic models see different views of a document: the words and character shape of its text, and its metadata (language,
source, stated length). In each round each model labels all documents without a sampled label of which it is sure
(``SURE``), and the other one learns from them and from the labelled documents. A round is a quadratic bound of the loss over the
whole corpus, minimised by conjugate gradients: sums over all documents' features, one for the gradient and one for each of
``STEPS`` directions, both views at once. The pseudo-labels of a class weigh ``TRUST`` times the labelled documents of that class at
most. Both views are then calibrated and combined on one fold of labelled documents that no model has seen, and the cutoff is the
highest one that rejects at most ``FALSE_REJECTION`` of the good ones of a second such fold.

Only the labelled documents are a bounded sample (``LABELLED``, by a hash of doc_id); features, pseudo-labels and scores cover all
rows. Every text is read once for its features, which are stored. A document is good if all its labels say quality and none toxic.

Edge cases: a null or empty text has no words; null metadata is a value of its own; without labels of both kinds every document
scores 0.5 and is kept; repeated labels count once; of the rows of one sampled doc_id one is fitted (the smallest by hash of the
text, ties by its columns); repeated rows get equal scores; long texts are handled whole; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.decontaminate import SPLIT
from lexmill.llm.scratch import Scratch
from lexmill.llm.textvec import SPACE, slices, tidy, words
from lexmill.session import ship_code

#: Labelled documents that the models are fitted on at most.
LABELLED = 12_000
#: Cells of the hashed vocabulary, words kept, rounds, directions of a round; least logit of a pseudo-label; weight of pseudo-labels
#: against labels.
WORD_BITS, WORDS, ROUNDS, STEPS, SURE, TRUST = 18, 2000, 3, 5, 2.5, 0.5
META, SHAPE = 256, 8
FALSE_REJECTION, RIDGE = 0.01, 1.0
_KIND = np.zeros((SHAPE - 2, 256), dtype=bool)
for _i, _chars in enumerate(("#*$%&<>", "|", "!", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "{}=_/\\")):
    _KIND[_i, [ord(_c) for _c in _chars]] = True


def _features(batch: pa.RecordBatch):
    """Yields (first row, cells of distinct words by row as (flat, offsets), shape matrix, metadata cells) for stretches of text."""
    for a, texts in slices(batch.column("text")):
        low = pc.utf8_lower(texts.cast(pa.large_string()))
        w = words(low, SPLIT)
        cell = (w.hash >> np.uint64(64 - WORD_BITS)).astype(np.int64)
        plain = words(texts)
        off = np.concatenate(([0], np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64))))
        total = np.maximum(np.diff(np.concatenate(([0], np.cumsum(~SPACE[plain.data])))[off]), 1)
        kinds = [np.diff(np.concatenate(([0], np.cumsum(k[plain.data])))[off]) / total for k in _KIND]
        n = np.diff(plain.first)
        shape = np.stack([*(np.minimum(1, 8 * k) for k in kinds), np.minimum(1, n / 50), total / np.maximum(n, 1) / 10], axis=1)
        part = batch.slice(a, len(texts))
        meta = np.array([[crc32(f"{k}={v}".encode()) % META for k, v in (("lang", g), ("source", s), ("length", int(math.log2(c + 1)) if c is not None and c >= 0 else None))] for g, s, c in zip(part.column("lang").to_pylist(), part.column("source").to_pylist(), part.column("n_chars").to_pylist(), strict=True)])
        yield a, cell, w.first, shape, meta


def _sampled(batches):
    for batch in batches:
        for a, cell, first, shape, meta in _features(batch):
            ids = batch.column("doc_id").slice(a, len(shape))
            y = batch.column("good").slice(a, len(shape))
            rows = [np.unique(cell[x:z]).astype(np.int32) for x, z in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([ids, y, pa.array(rows, pa.list_(pa.int32())), pa.array(list(shape.astype(np.float32)), pa.list_(pa.float32())), pa.array(list(meta.astype(np.int32)), pa.list_(pa.int32()))], names=["doc_id", "good", "cells", "shape", "meta"])


@dataclass
class Model:
    column: np.ndarray = field(default_factory=lambda: np.full(1 << WORD_BITS, -1, dtype=np.int32))  # cell -> kept word
    words: int = 0
    weights: list[np.ndarray] = field(default_factory=lambda: [np.zeros(SHAPE + 1), np.zeros(META + 1)])  # of the views, bias last
    mix: tuple[float, float, float] = (0.0, 0.0, 0.0)  # of the views' logits, and the bias
    cutoff: float = 0.0

    def kept_words(self, cell: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, kept word) of the distinct kept words of every row."""
        col = self.column[cell]
        at = np.flatnonzero(col >= 0)
        row = np.searchsorted(first, at, side="right") - 1
        key = np.unique(row * max(1, self.words) + col[at])
        return key // max(1, self.words), key % max(1, self.words)

    def logits(self, row, col, shape, meta) -> list[np.ndarray]:
        return [v.logit(b) for v, b in zip(views(row, col, self.words, shape, meta), self.weights, strict=True)]

    def score(self, row, col, shape, meta) -> np.ndarray:
        text, other = self.logits(row, col, shape, meta)
        return _sigmoid(self.mix[0] * text + self.mix[1] * other + self.mix[2])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class View:
    """Features of the sampled rows: 0/1 words as (row, column) pairs, then dense columns, then the constant."""

    def __init__(self, row: np.ndarray, column: np.ndarray, n_words: int, dense: np.ndarray):
        self.row, self.column, self.n_words, self.dense = row.astype(np.int32), column.astype(np.int32), n_words, dense
        self.width = n_words + dense.shape[1] + 1

    def logit(self, b: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=b[self.column], minlength=len(self.dense)) + self.dense @ b[self.n_words : -1] + b[-1]

    def gather(self, r: np.ndarray) -> np.ndarray:
        """The transpose times r."""
        return np.concatenate((np.bincount(self.column, weights=r[self.row], minlength=self.n_words), self.dense.T @ r, [r.sum()]))

    def squares(self, r: np.ndarray) -> np.ndarray:
        """The transpose of the squares times r."""
        return np.concatenate((np.bincount(self.column, weights=r[self.row], minlength=self.n_words), (self.dense**2).T @ r, [r.sum()]))


def views(row: np.ndarray, col: np.ndarray, n_words: int, shape: np.ndarray, meta_at: np.ndarray) -> list[View]:
    meta = np.zeros((len(shape), META))
    np.add.at(meta, (np.repeat(np.arange(len(shape)), meta_at.shape[1]), meta_at.ravel()), 1)
    none = np.zeros(0, dtype=np.int32)
    return [View(row, col, n_words, shape), View(none, none, 0, meta)]


def _penalty(width: int, ridge: float) -> np.ndarray:
    return np.append(np.full(width - 1, ridge), 1e-3)


def _bend(logit: np.ndarray) -> np.ndarray:
    """The curvature of the least parabola that touches the logistic loss at a logit and lies above it everywhere."""
    far = np.maximum(np.abs(logit), 1e-3)
    return np.tanh(far / 2) / (2 * far)


def _logistic(x: View, y: np.ndarray, weight: np.ndarray, ridge: float = RIDGE, steps: int = 25) -> np.ndarray:
    """Weights and bias (last) of a ridge-penalised logistic model, by Newton steps with a conjugate-gradient solver."""
    b, penalty = np.zeros(x.width), _penalty(x.width, ridge)
    for _ in range(steps):
        p = _sigmoid(x.logit(b))
        grad = x.gather(weight * (p - y)) + penalty * b
        curve = weight * np.maximum(p * (1 - p), 1e-6)
        step, r = np.zeros(len(b)), -grad
        d, rr = r.copy(), float(r @ r)
        enough = max(1e-8, 1e-4 * rr)  # each Newton step begins anew, so it need not be solved to the end
        for _ in range(60):
            if rr < enough:
                break
            q = x.gather(curve * x.logit(d)) + penalty * d
            alpha = rr / float(d @ q)
            step += alpha * d
            r -= alpha * q
            new = float(r @ r)
            d, rr = r + new / rr * d, new
        b += step
        if np.abs(step).max() < 1e-4:
            break
    return b


def _read(rows) -> tuple:
    """(flat cells, their rows, shape, metadata cells, which fold) of sampled rows."""
    cells = rows.column("cells").combine_chunks()
    lens = np.diff(cells.offsets.to_numpy())
    shape = np.array(rows.column("shape").to_pylist(), dtype=np.float64).reshape(-1, SHAPE)
    fold = np.array([crc32(str(i).encode()) % 5 for i in rows.column("doc_id").to_pylist()])
    return cells.values.to_numpy(), np.repeat(np.arange(len(lens)), lens), shape, np.array(rows.column("meta").to_pylist()), fold


class Labelled:
    """The sampled labelled documents: folds 2 to 4 train, fold 0 calibrates, fold 1 sets the cutoff."""

    def __init__(self, rows: pa.Table):
        self.y = np.array(rows.column("good").to_pylist(), dtype=np.int64)
        self.both = bool((self.y == 0).any() and (self.y == 1).any())
        if not self.both:
            return
        flat, owner, shape, meta_at, fold = _read(rows)
        self.fold = fold
        train = fold > 1
        # words that tell the classes apart in the training part
        count = lambda k: np.bincount(flat[(self.y[owner] == k) & train[owner]], minlength=1 << WORD_BITS)
        in_bad, in_good = count(0), count(1)
        n_bad, n_good = (max(1, int((train & (self.y == k)).sum())) for k in (0, 1))
        rate = (in_good + in_bad) / (n_good + n_bad)
        z = np.abs(in_good / n_good - in_bad / n_bad) / np.sqrt(np.maximum(rate * (1 - rate), 1e-9) * (1 / n_good + 1 / n_bad))
        z[in_good + in_bad < 4] = 0
        kept = np.argsort(-z, kind="stable")[:WORDS]
        kept = kept[z[kept] > 3]
        self.model = Model(words=len(kept))
        self.model.column[kept] = np.arange(len(kept))
        col = self.model.column[flat]
        self.views = views(owner[col >= 0], col[col >= 0], len(kept), shape, meta_at)
        self.weight = train.astype(np.float64)
        self.model.weights = [_logistic(v, self.y, self.weight) for v in self.views]

    def learn(self, sums) -> None:
        """A round. ``sums(model, directions)`` gives ``pseudo_labelled`` of all documents, by view and pseudo-label."""
        found, at = sums(self.model, None), []
        for i, (v, b) in enumerate(zip(self.views, self.model.weights, strict=True)):
            logit, penalty, w = v.logit(b), _penalty(v.width, RIDGE), {}
            bend = self.weight * _bend(logit)
            grad, diagonal = v.gather(self.weight * (_sigmoid(logit) - self.y)) + penalty * b, v.squares(bend) + penalty
            for k in (0, 1):
                x = found.get((i, k))
                if x is not None and x[-1]:
                    w[k] = TRUST * min(1.0, float((self.weight * (self.y == k)).sum() / x[-1]))
                    grad += w[k] * x[: v.width]
                    diagonal += w[k] * x[v.width : -1]
            z = -grad / diagonal
            at.append({"view": v, "bend": bend, "penalty": penalty, "w": w, "diagonal": diagonal, "step": np.zeros(v.width), "r": -grad, "d": z, "rz": float(-grad @ z)})
        for _ in range(STEPS):
            found = sums(self.model, [s["d"] for s in at])
            for i, s in enumerate(at):
                d = s["d"]
                q = s["view"].gather(s["bend"] * s["view"].logit(d)) + s["penalty"] * d + sum(w * found[i, k] for k, w in s["w"].items())
                if (bent := float(d @ q)) <= 0:
                    continue
                alpha = s["rz"] / bent
                s["step"] += alpha * d
                s["r"] -= alpha * q
                z = s["r"] / s["diagonal"]
                new = float(s["r"] @ z)
                s["d"], s["rz"] = z + new / s["rz"] * d, new
        self.model.weights = [b + s["step"] for b, s in zip(self.model.weights, at, strict=True)]

    def finish(self) -> Model:
        """Calibrates and combines the views and sets the cutoff."""
        both = np.stack([v.logit(b) for v, b in zip(self.views, self.model.weights, strict=True)], axis=1)
        one, other = self.fold == 0, self.fold == 1
        if (self.y[one] == 1).any() and (self.y[one] == 0).any():
            none = np.zeros(0, dtype=np.int32)
            b = _logistic(View(none, none, 0, both[one]), self.y[one].astype(np.float64), np.ones(one.sum()), ridge=0.1)
            self.model.mix = (max(0.0, float(b[0])), max(0.0, float(b[1])), float(b[2]))
            p = _sigmoid(self.model.mix[0] * both[:, 0] + self.model.mix[1] * both[:, 1] + self.model.mix[2])
            ok = np.sort(p[other & (self.y == 1)])
            self.model.cutoff = min(0.5, float(ok[int(FALSE_REJECTION * len(ok))])) if len(ok) else 0.0
        return self.model


def pseudo_labelled(model: Model, row, col, shape, meta, free, directions=None) -> dict[tuple[int, int], np.ndarray]:
    """By view and pseudo-label of the other view: gradient of the loss, diagonal of its bound's curvature, number of documents; or, given
    a direction for each view, that curvature times the direction."""
    both = views(row, col, model.words, shape, meta)
    logit = [v.logit(b) for v, b in zip(both, model.weights, strict=True)]
    out = {}
    for i, v in enumerate(both):
        p, bend, teacher = _sigmoid(logit[i]), _bend(logit[i]), logit[1 - i]
        for k in (0, 1):
            sure = free & ((teacher > SURE) if k else (teacher < -SURE))
            if directions is not None:
                out[i, k] = v.gather(np.where(sure, bend * v.logit(directions[i]), 0.0))
            else:
                out[i, k] = np.concatenate((v.gather(np.where(sure, p - k, 0.0)), v.squares(np.where(sure, bend, 0.0)), [float(sure.sum())]))
    return out


STORED = "doc_id binary, known binary, free binary, row binary, col binary, shape binary, meta binary"


def _store(model):
    """Features of a stretch of documents, packed."""

    def run(batches):
        m = model.value
        for batch in batches:
            for a, cell, first, shape, meta in _features(batch):
                ids, labelled = (batch.column(c).slice(a, len(shape)) for c in ("doc_id", "good"))
                row, col = m.kept_words(cell, first)
                parts = [np.asarray(pc.fill_null(ids, 0)), np.asarray(ids.is_valid()), np.asarray(labelled.is_null()), row.astype(np.uint32), col.astype(np.uint16), shape.astype(np.float32), meta.astype(np.uint16)]
                yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in parts], names=[c.split()[0] for c in STORED.split(", ")])

    return run


def _stored(batches):
    """(doc_id, known, free, row, col, shape, meta) of packed features."""
    types = dict(zip((c.split()[0] for c in STORED.split(", ")), (np.int64, bool, bool, np.uint32, np.uint16, np.float32, np.uint16), strict=True))
    for batch in batches:
        for r in zip(*(batch.column(c).to_pylist() for c in types), strict=True):
            doc_id, known, free, row, col, shape, meta = (np.frombuffer(x, dtype=t) for x, t in zip(r, types.values(), strict=True))
            n = len(doc_id)
            yield doc_id, known, free, row.astype(np.int64), col.astype(np.int64), shape.astype(np.float64).reshape(n, SHAPE), meta.astype(np.int64).reshape(n, -1)


def _sums(asked):
    """Sums of ``pseudo_labelled`` over a partition: (view, label, at, x)."""

    def run(batches):
        total: dict = {}
        model, directions = asked.value
        for _, _, free, row, col, shape, meta in _stored(batches):
            for k, x in pseudo_labelled(model, row, col, shape, meta, free, directions).items():
                total[k] = total.get(k, 0) + x
        for (i, k), x in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([i] * len(x), pa.int32()), pa.array([k] * len(x), pa.int32()), pa.array(range(len(x)), pa.int32()), pa.array(x)], names=["view", "label", "at", "x"])

    return run


def fit(spark: SparkSession, documents: DataFrame, labels: DataFrame, scratch: Scratch) -> tuple[Model, DataFrame | None]:
    """The model, and the features of all documents; the sampled ids (``LABELLED`` at most) are all that is broadcast."""
    ship_code(spark)
    docs = _columns(documents)
    good = F.min(F.when((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0), 1).otherwise(0)).cast("int")
    labelled = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(good.alias("good"))
    ids = scratch.save(labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED), "sampled")
    found = docs.join(F.broadcast(ids), "doc_id")
    row = F.struct(F.xxhash64("text").alias("h"), *found.columns)
    one = found.groupBy("doc_id").agg(F.min(row).alias("r")).select("r.*").select(*found.columns)
    sampled = Labelled(one.mapInArrow(tidy(_sampled), "doc_id long, good int, cells array<int>, shape array<float>, meta array<int>").toArrow().sort_by("doc_id"))
    if not sampled.both:
        return Model(), None
    first = spark.sparkContext.broadcast(sampled.model)
    features = scratch.save(docs.join(F.broadcast(ids), "doc_id", "left").mapInArrow(tidy(_store(first)), STORED), "features")

    def sums(model: Model, directions) -> dict:
        now = spark.sparkContext.broadcast((model, directions))
        out: dict = {}
        summed = features.mapInArrow(tidy(_sums(now)), "view int, label int, at int, x double").groupBy("view", "label", "at").agg(F.sum("x").alias("x"))
        for r in summed.orderBy("view", "label", "at").collect():  # a few numbers for each weight
            out.setdefault((r["view"], r["label"]), []).append(r["x"])
        now.unpersist()
        return {k: np.array(x) for k, x in out.items()}

    for _ in range(ROUNDS):
        sampled.learn(sums)
    return sampled.finish(), features


def _columns(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("n_chars").cast("long").alias("n_chars"))


def _scores(model):
    def run(batches):
        m = model.value
        for doc_id, known, _, *x in _stored(batches):
            p = m.score(*x)
            yield pa.RecordBatch.from_arrays([pa.array(doc_id, mask=~known), pa.array(p), pa.array(p >= m.cutoff)], names=["doc_id", "score", "kept"])

    return run


def classify(spark: SparkSession, documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score (probability of being good), kept."""
    model, features = fit(spark, documents, labels, Scratch(spark, "classifier"))
    if features is None:
        return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0.5).alias("score"), F.lit(True).alias("kept"))
    return features.mapInArrow(tidy(_scores(spark.sparkContext.broadcast(model))), "doc_id long, score double, kept boolean")


def _kept(model, places: list[int]):
    """Rows that the model keeps; the columns it reads stand at ``places``."""

    def run(batches):
        m = model.value
        for batch in batches:
            read = pa.RecordBatch.from_arrays([batch.column(i).cast(t) for i, t in zip(places, (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["doc_id", "text", "lang", "source", "n_chars"])
            keep = np.zeros(len(batch), dtype=bool)
            for a, cell, first, shape, meta in _features(read):
                keep[a : a + len(shape)] = m.score(*m.kept_words(cell, first), shape, meta) >= m.cutoff
            yield batch.filter(pa.array(keep))

    return run


def keep_good(spark: SparkSession, documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier keeps; all columns stay."""
    model, features = fit(spark, documents, labels, Scratch(spark, "classifier"))
    if features is None:
        return documents
    places = [documents.columns.index(c) for c in ("doc_id", "text", "lang", "source", "n_chars")]
    return documents.mapInArrow(tidy(_kept(spark.sparkContext.broadcast(model), places)), documents.schema)
