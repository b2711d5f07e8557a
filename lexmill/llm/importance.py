"""Importance resampling towards a target: hashed n-gram counts as a stored sparse matrix, whose column sums give both
distributions and whose product with the buckets' gains gives every document's weight.

The matrix is written once as blocks of compressed sparse rows (CSR) of about a megabyte of text each; sums and product read blocks,
never texts. Only tables of ``buckets`` rows reach the driver.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.llm.scratch import Scratch
from lexmill.llm.textvec import PIECE, buffer_of, slices

#: Separators of words: all of ASCII but letters and digits.
GAP = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
#: Bytes by which a crc is moved on in one look-up.
STEP = 64


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, t >> 1 ^ np.uint32(0xEDB88320), t >> 1)
    return t


CRC = _crc_table()


def _shifts() -> np.ndarray:
    """[n * 1024 + k * 256 + v]: the crc ``v << 8 k`` followed by n zero bytes; a crc is linear in its bits."""
    x = np.concatenate([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    out = [x]
    for _ in range(STEP):
        x = CRC[x & 255] ^ x >> 8
        out.append(x)
    return np.concatenate(out)


SHIFT = _shifts()


def _moved(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The crcs' part in a crc of what has n more bytes."""
    out, at, left = crc, np.arange(len(crc)), n
    while len(at):
        base, x = np.minimum(left, STEP) * 1024, out[at]
        y = SHIFT[base + (x & 255)] ^ SHIFT[base + 256 + (x >> 8 & 255)] ^ SHIFT[base + 512 + (x >> 16 & 255)] ^ SHIFT[base + 768 + (x >> 24)]
        if len(at) == len(out):  # the first round, of all
            out = y
        else:
            out[at] = y
        more = left > STEP
        at, left = at[more], left[more] - STEP
    return out


def _joined(head: np.ndarray, tail: np.ndarray, tail_bytes: np.ndarray) -> np.ndarray:
    """crc32 of head, a space and tail, from the crcs of both."""
    state = ~head
    spaced = ~(CRC[(state ^ 32) & 255] ^ state >> 8)
    return _moved(spaced, tail_bytes) ^ tail


def _word_crcs(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    order = np.argsort(-size, kind="stable")
    s, n = start[order], size[order]
    state = np.full(len(s), 0xFFFFFFFF, dtype=np.uint32)
    longest = int(np.searchsorted(-n, -STEP, "left"))  # words over STEP bytes
    for j in range(int(n[longest]) if longest < len(n) else 0):
        last = int(np.searchsorted(-n, -j, "left"))
        state[longest:last] = CRC[(state[longest:last] ^ data[s[longest:last] + j]) & 255] ^ state[longest:last] >> 8
    state = ~state
    for i in range(longest):
        state[i] = zlib.crc32(data[s[i] : s[i] + n[i]])
    out = np.empty_like(state)
    out[order] = state
    return out


def _cuts(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of about PIECE bytes that end at separators."""
    a = 0
    while a < len(data):
        b = min(len(data), a + PIECE)
        while b < len(data):
            gap = np.flatnonzero(GAP[data[b : b + PIECE]])
            b = min(len(data), b + (int(gap[0]) if len(gap) else PIECE))
            if len(gap):
                break
        yield a, b
        a = b


def _features(data: np.ndarray, off: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text of each word, text of each feature, crc32 of each feature) of folded texts, stretch by stretch; runs of up to ``most`` words
    go on from one stretch to the next."""
    text_, crc_, size_ = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
    for a, b in _cuts(data):
        inside = ~GAP[data[a:b]]
        edge = off[(off > a) & (off < b)] - a
        begin, end = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        begin[edge], end[edge - 1] = inside[edge], inside[edge - 1]
        start, stop = np.flatnonzero(begin) + a, np.flatnonzero(end) + a + 1
        old = len(text_)
        text = np.concatenate([text_, np.searchsorted(off, start, "right") - 1])
        size = np.concatenate([size_, stop - start])
        crc = np.concatenate([crc_, _word_crcs(data, start, stop - start)])
        texts, crcs, run = [text[old:]], [crc[old:]], crc
        for k in range(1, most):
            if len(text) <= k:
                break
            run = _joined(run[: len(text) - k], crc[k:], size[k:])
            ok = (text[k:] == text[: len(text) - k]) & (np.arange(k, len(text)) >= old)
            texts.append(text[k:][ok])
            crcs.append(run[ok])
        yield text[old:], np.concatenate(texts), np.concatenate(crcs)
        keep = slice(max(0, len(text) - most + 1), None)
        text_, crc_, size_ = text[keep], crc[keep], size[keep]


def _packed(x: np.ndarray) -> pa.Array:
    """One binary value: numbers in as few bytes each, 1, 2 or 4, as the largest takes."""
    top = int(x.max()) if len(x) else 0
    return pa.array([x.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4").tobytes()])


def _unpacked(x: pa.Scalar, n: int) -> np.ndarray:
    buffer = x.as_buffer()
    return np.frombuffer(buffer, dtype=f"<u{max(1, buffer.size // max(1, n))}").astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], buckets: int, most: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, texts in slices(batch.column(1)):
            n = len(texts)
            data, off = buffer_of(texts)
            words, keys, counts = np.zeros(n, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
            for word_text, text, crc in _features(FOLD[data], off, most):
                words += np.bincount(word_text, minlength=n)
                key, count = np.unique(text * buckets + crc % buckets, return_counts=True)
                if len(keys):
                    key, back = np.unique(np.concatenate([keys, key]), return_inverse=True)
                    count = np.bincount(back, weights=np.concatenate([counts, count])).astype(np.int64)
                keys, counts = key, count
            ends = np.searchsorted(keys, np.arange(n + 1) * buckets)
            one = pa.array([0, n], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(one, batch.column(0).slice(first, n)), pa.ListArray.from_arrays(one, pa.array(words)), pa.array([ends.astype("<i8").tobytes()]), _packed(keys % buckets), _packed(counts)],
                ["ids", "words", "ends", "buckets", "counts"],
            )


def count_matrix(texts: DataFrame, scratch: Scratch, name: str, buckets: int = 10000, most: int = 3) -> DataFrame:
    """The document-by-bucket matrix of ``texts`` (doc_id, text), stored in blocks of rows: ids, words of each, and CSR arrays
    (where each row ends, buckets, counts; little-endian, in as few bytes each as a block's largest takes)."""
    kind = texts.schema[0].dataType.simpleString()
    rows = texts.mapInArrow(lambda batches: _blocks(batches, buckets, most), f"ids array<{kind}>, words array<long>, ends binary, buckets binary, counts binary")
    rows.write.mode("overwrite").option("compression", "zstd").parquet(scratch.path(name))
    return scratch.spark.read.schema(rows.schema).parquet(scratch.path(name))


def column_sums(matrix: DataFrame, buckets: int = 10000) -> np.ndarray:
    """Features of every bucket: each task adds up its blocks; ``buckets`` rows at most reach the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for ends, b, c in zip(*batch.columns, strict=True):
                n = int(np.frombuffer(ends.as_buffer(), dtype="<i8")[-1])
                total += np.bincount(_unpacked(b, n), weights=_unpacked(c, n), minlength=buckets).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    found = matrix.select("ends", "buckets", "counts").mapInArrow(add, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, dtype=np.int64)
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of both smoothed distributions, rounded down."""
    buckets, s, t = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float(y + 1) * (s + buckets) / (float(x + 1) * (t + buckets)))) for x, y in zip(source.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def weights(matrix: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the matrix times the gains."""
    kind = matrix.schema["ids"].dataType.elementType.simpleString()

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, words, ends, b, c in zip(*batch.columns, strict=True):
                end = np.frombuffer(ends.as_buffer(), dtype="<i8")
                count = _unpacked(c, int(end[-1]))
                n, w = (np.concatenate([[0], np.cumsum(x)]) for x in (count, count * gain[_unpacked(b, int(end[-1]))]))
                yield pa.RecordBatch.from_arrays([ids.values, words.values, pa.array(n[end[1:]] - n[end[:-1]]), pa.array(w[end[1:]] - w[end[:-1]])], ["doc_id", "n_words", "n_features", "weight"])

    return matrix.select("ids", "words", "ends", "buckets", "counts").mapInArrow(product, f"doc_id {kind}, n_words long, n_features long, weight long")


def ranked_draw(rows: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """``rows`` with ``rank`` 1, 2, ... by falling score, ties by doc_id, for the first ``percent`` in a hundred; else null.

    Ranges of (score, doc_id) are sorted each on its own; a place is the range's offset and the place within it.
    """
    by = [F.desc("score"), F.asc("doc_id")]
    placed = scratch.save(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("at", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("size"))  # a row for each partition
    before = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"), F.sum("size").over(Window.partitionBy()).alias("all"))
    place = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    drawn = F.expr(f"all * {int(percent)} div 100")
    return placed.withColumn("part", part).join(F.broadcast(before), "part").withColumn("rank", F.when(place <= drawn, place)).select(*rows.columns, "rank")


def importance_resample(spark: SparkSession, documents: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, buckets: int = 10000, most: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, n_features, weight, score, rank, n_words) of every document: drawn without replacement towards ``target`` (text).

    Words are runs of ASCII letters and digits and of all other characters beyond ASCII, A-Z lower-cased; features are runs of 1 to
    ``most`` words, hashed by crc32 into ``buckets``. ``score`` adds to the weight a Gumbel variable that hangs on the seed and the
    doc_id alone, so the highest scores are a draw by weight. Only documents of ``least_words`` words or more are drawn.
    A null or empty text has no features and weight 0; a null doc_id is hashed as empty text and comes first among ties; repeated rows
    are documents of their own. Other columns are not read. Without target texts the target is uniform; no documents, no rows.
    """
    scratch = Scratch(spark, "importance")
    matrix = count_matrix(documents.select("doc_id", "text"), scratch, "source", buckets, most)
    wanted = count_matrix(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), scratch, "target", buckets, most)
    gain = gains(column_sums(matrix, buckets), column_sums(wanted, buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{int(seed)}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = scratch.save(weights(matrix, gain).withColumn("score", F.col("weight") + gumbel), "scored")
    some = F.col("n_words") >= least_words
    drawn = ranked_draw(scored.where(some), scratch, percent)
    return drawn.unionByName(scored.where(~some).withColumn("rank", F.lit(None).cast("long"))).select("doc_id", "n_features", "weight", "score", "rank", "n_words")
