"""Spelling variants: words of a corpus that one edit turns into each other, by a positional q-gram inverted index.

A posting list is named by (length of its words, q, place, gram). One edit destroys only the grams that cover its place, so two grams
of a word that don't overlap can't both be lost: a word asks the two shortest such lists of its own length and of the length below, at
the places that one edit can shift to. Lists and questions meet by key in one exchange, whose external sort heap-merges the posting
runs; the other, longer lists are not merged: a candidate's overlap with them is counted from the two words, pairs below the
one-edit bound (grams - q) go, and the rest are verified. A pair that two lists hold is made one by a last exchange of pairs.

List lengths come from a sketch of fixed size. It steers which lists are asked and into how many parts a long list is cut, never
what is found: questions go to every part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.scratch import Scratch

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Least code points of a word, least occurrences, and how many times as frequent a form is.
LEAST, OFTEN, TIMES = 7, 2, 10
#: Longest grams; words longer than SHORT are indexed by their halves only, so that a long word has few postings.
Q, SHORT = 4, 40
#: Cells of the sketch of list lengths, and postings of one part of a list.
CELLS, PART = 1 << 20, 2048
#: Pairs verified at once.
PAIRS = 1 << 17
POSTINGS = "key long, part int, kind byte, b binary, n long"


def word_counts(documents: DataFrame, every: int = 31, least: int = LEAST, often: int = OFTEN) -> DataFrame:
    """(word, n): runs of Latin-1 letters, A-Z lower-cased, with planted deletions, that occur ``often`` times in all texts.

    Where ``every`` divides the crc32 of ``<doc_id>:<run>``, the run loses one code point. A null text has no words; a null doc_id
    is written as empty.
    """
    runs = documents.select("doc_id", F.explode(F.regexp_extract_all(F.col("text"), F.lit(f"([A-Za-zÀ-ÿ]{{{least},}})"), F.lit(1))).alias("r"))
    low = runs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), F.translate("r", UPPER, UPPER.lower()).alias("r"))
    h = low.select("r", F.crc32(F.concat("d", F.lit(":"), "r")).alias("h")).withColumn("at", (F.col("h") % F.length("r")).cast("int"))
    cut = F.concat(F.expr("substring(r, 1, at)"), F.expr("substring(r, at + 2)"))
    words = h.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("r")).alias("word")).where(F.length("word") >= least)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= often)


def gram_size(length: int) -> int:
    """Of what a word of this length asks: two grams that don't overlap must fit."""
    return min(Q, length // 2) if length <= SHORT else length // 2


def _cells(keys: np.ndarray) -> np.ndarray:
    x = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(44)).astype(np.int64) & (CELLS - 1)


def _short_keys(m: np.ndarray, q: int) -> np.ndarray:
    """Keys of every gram of equally long words (a row of bytes each), a column for each place."""
    places = m.shape[1] - q + 1
    gram = np.zeros((len(m), places), dtype=np.int64)
    for j in range(q):
        gram = gram << 8 | m[:, j : j + places]
    return gram | np.arange(places) << 32 | q << 38 | m.shape[1] << 42


def _half_keys(word: bytes, asked: int, listed: int) -> list[int]:
    """Keys of a long word's first and last grams, among words of length ``listed`` for words of length ``asked``; negative, unlike
    short keys."""
    q, out = gram_size(asked), []
    for end, half in enumerate((word[:q], word[len(word) - q :])):
        name = b"%d:%d:%d:" % (asked, listed, end)
        out.append(int.from_bytes(hashlib.blake2b(name + half, digest_size=8).digest(), "little", signed=True) | -(1 << 63))
    return out


def _by_length(words: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray | None]]:
    """(length, rows, their bytes) of a binary array; no matrix of long words."""
    words = words.cast(pa.large_binary())
    _, offs, data = words.buffers()
    off = np.frombuffer(offs, dtype=np.int64)[words.offset : words.offset + len(words) + 1]
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    size = np.diff(off)
    for length in np.unique(size).tolist():
        rows = np.flatnonzero(size == length)
        yield length, rows, flat[off[rows][:, None] + np.arange(length)] if length <= SHORT else None


def _listed(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every posting: a word is asked by words of its own length and of the next."""
    rows, keys = [], []
    for length, at, m in _by_length(words):
        for q in sorted({gram_size(x) for x in (length, length + 1) if x <= SHORT}):
            k = _short_keys(m, q)
            keys.append(k.ravel())
            rows.append(np.repeat(at, k.shape[1]))
        for asked in (x for x in (length, length + 1) if x > SHORT):
            for i in at.tolist():
                keys.append(np.array(_half_keys(words[i].as_py(), asked, length), dtype=np.int64))
                rows.append(np.full(2, i))
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *rows]), np.concatenate([none, *keys])


def _asked(words: pa.Array, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every question: lists that no word is in are left out."""
    rows, keys = [], []

    def put(at, k):
        some = sketch[_cells(k)] > 0
        rows.append(at[some])
        keys.append(k[some])

    for length, at, m in _by_length(words):
        if length > SHORT:
            for i in at.tolist():
                k = np.array([k for other in (length, length - 1) for k in _half_keys(words[i].as_py(), length, other)], dtype=np.int64)
                put(np.full(len(k), i), k)
            continue
        q = gram_size(length)
        own = _short_keys(m, q)
        places = own.shape[1]
        below = own - (1 << 42)  # the same gram and place among words one shorter
        back = below - (1 << 32)  # and one place before
        equal = sketch[_cells(own)].astype(np.int64)
        less = np.zeros_like(equal)
        less[:, :-1] += sketch[_cells(below[:, :-1])]
        less[:, 1:] += sketch[_cells(back[:, 1:])]
        for size, lists in ((equal, [(own, 0, places)]), (less, [(below, 0, places - 1), (back, 1, places)])):
            best = np.minimum.accumulate(size, axis=1)
            second = q + np.argmin(size[:, q:] + best[:, : places - q], axis=1)
            first = np.where(np.arange(places) <= (second - q)[:, None], size, np.iinfo(np.int64).max).argmin(axis=1)
            for k, low, high in lists:
                for place in (first, second):
                    ok = np.flatnonzero((place >= low) & (place < high))
                    put(at[ok], k[ok, place[ok]])
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *rows]), np.concatenate([none, *keys])


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(CELLS, dtype=np.int64)
    for batch in batches:
        _, keys = _listed(batch.column(0))
        total += np.bincount(_cells(keys), minlength=CELLS)
    at = np.flatnonzero(total)
    for i in range(0, len(at), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(at[i : i + (1 << 16)]), pa.array(total[at[i : i + (1 << 16)]])], ["cell", "size"])


def _postings(batches: Iterator[pa.RecordBatch], sketch: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, n = batch.column(0), batch.column(1)
        row, key = _listed(words)
        hashed = np.array([int.from_bytes(hashlib.blake2b(w, digest_size=4).digest(), "little") for w in words.to_pylist()], dtype=np.int64)
        parts = -(-sketch[_cells(key)].astype(np.int64) // PART)
        part = hashed[row] % np.maximum(parts, 1)
        q_row, q_key = _asked(words, sketch)
        times = -(-sketch[_cells(q_key)].astype(np.int64) // PART)
        q_part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        kind = np.concatenate([np.zeros(len(row), dtype=np.int8), np.ones(len(q_part), dtype=np.int8)])
        rows = np.concatenate([row, np.repeat(q_row, times)])
        cols = [np.concatenate([key, np.repeat(q_key, times)]), np.concatenate([part, q_part]).astype(np.int32), kind]
        for i in range(0, len(rows), 1 << 16):
            cut = slice(i, i + (1 << 16))
            take = pa.array(rows[cut])
            yield pa.RecordBatch.from_arrays([pa.array(cols[0][cut]), pa.array(cols[1][cut]), pa.array(cols[2][cut]), words.take(take), n.take(take)], ["key", "part", "kind", "b", "n"])


def _near_short(a: np.ndarray, b: np.ndarray, q: int) -> np.ndarray:
    """Which pairs of words (a row of bytes each), b as long as a or one shorter, are one edit apart. Overlaps in grams at places that
    one edit can shift to are counted before anything is verified."""

    def same(eq: np.ndarray) -> np.ndarray:
        out = eq[:, : eq.shape[1] - q + 1].copy()
        for j in range(1, q):
            out &= eq[:, j : eq.shape[1] - q + 1 + j]
        return out

    m = b.shape[1]
    if a.shape[1] == m:
        eq = a == b
        at = same(eq)
        return (at.sum(axis=1) >= at.shape[1] - q) & ((~eq).sum(axis=1) == 1)
    here, after = a[:, :m] == b, a[:, 1:] == b  # the shorter word before and after the letter that it lacks
    at = same(here) | same(after)
    ok = at.sum(axis=1) >= at.shape[1] - (q - 1)
    lead = np.where(here.all(axis=1), m, here.argmin(axis=1))
    tail = np.where(after.all(axis=1), m, after[:, ::-1].argmin(axis=1))
    return ok & (lead + tail >= m)


def _one_edit(a: bytes, b: bytes) -> bool:
    """For long words: b as long as a or one shorter."""
    x, y = np.frombuffer(a, dtype=np.uint8), np.frombuffer(b, dtype=np.uint8)
    if len(x) == len(y):
        return int((x != y).sum()) == 1
    here, after = x[:-1] == y, x[1:] == y
    lead = len(y) if here.all() else int(here.argmin())
    tail = len(y) if after.all() else int(after[::-1].argmin())
    return lead + tail >= len(y)


def _chunks(batches: Iterator[pa.RecordBatch], rows: int = 1 << 15) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs from rows sorted by key, part and kind: a part of a list comes before the words that ask for it. Only the list's
    rows are held between batches."""
    held = None
    for table in _chunks(batches):
        if held is not None and len(held):
            table = pa.concat_tables([held, table])
        table = table.combine_chunks()
        key, part, kind = (table[c].to_numpy() for c in ("key", "part", "kind"))
        new = np.ones(len(key), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (part[1:] != part[:-1])
        group = np.cumsum(new) - 1
        start = np.flatnonzero(new)
        size = np.bincount(group, weights=kind == 0, minlength=len(start)).astype(np.int64)
        asking = np.flatnonzero((kind == 1) & (size[group] > 0))
        words, n = table["b"].combine_chunks(), table["n"].to_numpy()
        if isinstance(words, pa.ChunkedArray):
            words = words.chunk(0) if words.num_chunks else pa.array([], pa.binary())
        todo = size[group[asking]]
        edge = np.cumsum(todo)
        lo = 0
        while lo < len(asking):
            hi = max(lo + 1, int(np.searchsorted(edge, (edge[lo - 1] if lo else 0) + PAIRS, "right")))
            i = np.repeat(asking[lo:hi], todo[lo:hi])
            j = np.repeat(start[group[asking[lo:hi]]], todo[lo:hi]) + np.arange(len(i)) - np.repeat(edge[lo:hi] - todo[lo:hi] - (edge[lo - 1] if lo else 0), todo[lo:hi])
            lo = hi
            found = _verified(words, i, j)
            if len(found):
                a, b = i[found], j[found]
                yield pa.RecordBatch.from_arrays([words.take(pa.array(a)), pa.array(n[a]), words.take(pa.array(b)), pa.array(n[b])], ["a", "a_n", "b", "b_n"])
        last = np.flatnonzero(group == len(start) - 1)
        held = table.take(pa.array(last[kind[last] == 0])) if len(last) else None


def _verified(words: pa.Array, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Places in i, j of the pairs that are near: i asks, j is listed. Equally long words ask each other; the larger one's is kept."""
    wide = words.cast(pa.large_binary())
    off = np.frombuffer(wide.buffers()[1], dtype=np.int64)[wide.offset : wide.offset + len(wide) + 1]
    flat, size = np.frombuffer(wide.buffers()[2], dtype=np.uint8), np.diff(off)
    kinds = np.where(size[i] > SHORT, -1, size[i] * 2 + (size[i] == size[j]))
    out = []
    for kind in np.unique(kinds).tolist():
        at = np.flatnonzero(kinds == kind)
        if kind < 0:
            for p in at.tolist():
                a, b = words[int(i[p])].as_py(), words[int(j[p])].as_py()
                if (len(a) > len(b) or b < a) and _one_edit(a, b):
                    out.append(np.array([p]))
            continue
        length, m = kind // 2, kind // 2 - 1 + kind % 2
        a, b = flat[off[i[at]][:, None] + np.arange(length)], flat[off[j[at]][:, None] + np.arange(m)]
        x = np.flatnonzero(_near_short(a, b, gram_size(length)))
        if m == length:
            p = (a[x] != b[x]).argmax(axis=1)
            x = x[b[x, p] < a[x, p]]
        out.append(at[x])
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


def near_words(spark: SparkSession, words: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, n, near, near_n): every two words of ``words`` (word of Latin-1 letters, n) that one edit parts, in both directions."""
    stored = words.select(F.encode("word", "ISO-8859-1").alias("b"), "n")
    sizes = stored.select("b").mapInArrow(_lengths, "cell long, size long").groupBy("cell").agg(F.sum("size").alias("size")).toArrow()  # CELLS rows at most
    sketch = np.zeros(CELLS, dtype=np.int32)
    sketch[sizes["cell"].to_numpy()] = np.minimum(sizes["size"].to_numpy(), 2**31 - 1)
    shared = spark.sparkContext.broadcast(sketch)  # of fixed size

    def postings(batches):
        return _postings(batches, shared.value)

    rows = stored.mapInArrow(postings, POSTINGS).repartition("key", "part").sortWithinPartitions("key", "part", "kind")
    pairs = scratch.save(rows.mapInArrow(_merge, "a binary, a_n long, b binary, b_n long").distinct(), "pairs")
    text = lambda c: F.decode(F.col(c), "ISO-8859-1")
    return pairs.select(text("a").alias("word"), F.col("a_n").alias("n"), text("b").alias("near"), F.col("b_n").alias("near_n")).unionAll(pairs.select(text("b"), "b_n", text("a"), "a_n"))


def followed(forms: DataFrame, scratch: Scratch, limit: int = 12) -> DataFrame:
    """(word, root) for forms (word, form): forms followed to the last. A form is TIMES as frequent as its word, so chains end; each
    round doubles the steps taken."""
    done = scratch.save(forms.select("word", F.col("form").alias("root")), "roots-0")
    for i in range(1, limit):
        onward = done.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = scratch.save(done.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), f"roots-{i}")
        moved = new.where("moved").limit(1).count()
        done = new.select("word", "root")
        if not moved:
            return done
    raise RuntimeError(f"no end after {limit} rounds")


def spelling_variants(spark: SparkSession, documents: DataFrame, every: int = 31) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for every word of ``word_counts``.

    Near words are one inserted, deleted or replaced code point apart. ``form`` is the near word of largest n, of ties the smallest,
    if it is TIMES as frequent; ``root`` follows forms to the last and is the word itself without a form. No texts, no words; other
    columns of ``documents`` are not read; repeated rows count again.
    """
    scratch = Scratch(spark, "spelling")
    words = scratch.save(word_counts(documents, every), "words")
    near = near_words(spark, words, scratch)
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w")))).alias("best")
    every_word = words.select("word", "n", F.lit(None).cast("string").alias("near"), F.lit(None).cast("long").alias("near_n")).unionAll(near)
    per = every_word.groupBy("word").agg(F.max("n").alias("n"), F.count("near").alias("n_near"), best)
    form: Column = F.when(-F.col("best.m") >= TIMES * F.col("n"), F.col("best"))
    per = scratch.save(per.select("word", "n", "n_near", form.getField("w").alias("form"), (-form.getField("m")).alias("form_n")), "forms")
    roots = followed(per.where("form is not null"), scratch)
    return per.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
