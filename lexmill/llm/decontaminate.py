"""Benchmark decontamination: every training passage is a BM25 query against an inverted index of test items.

Impacts are divided by an item's score for its own text, so one threshold holds for all items: a passage must score a share
``MATCH`` of the item itself. Retrieval is block-max WAND with that fixed threshold: cursors over the passage's posting lists, in
order of items, choose the first item that the terms' highest impacts can lift over the threshold; if the highest impacts of that
item's block cannot, all cursors skip the block. A first screen asks the blocks of all passages of a stretch of text at once: terms
so common that no item can reach the threshold by them alone are non-essential, and only passages for which the essential terms'
block maxima can reach the threshold in some block get cursors. No item that reaches the threshold is missed. Hits are verified by
the share of the item's question and of its answer (word 3-grams) that the passage has; a question or answer under three words must
stand there as a phrase.

Items are indexed whole. They are kept apart by length (powers of two); the passages for a length are windows of twice as many words,
by half their length, so an item lies whole in one of them. Document frequencies and the mean length are those of all items. An
index of ``SHARD_WORDS`` words of items is broadcast at a time; more items mean more passes, never a larger broadcast, and the same hits.

Words are runs of letters and digits of ASCII and of all characters beyond it, in lower case; in scripts that don't part words by
spaces (SCRIPTS) every code point is a word.

Edge cases: null or empty texts and items match nothing; a question or answer without a word is replaced by the whole item; an
item under ``FEW`` words can't be told from ordinary text and only matches a text of just these words; equal texts are indexed once and all their ids reported, texts of one id each on its own;
repeated rows are judged each on its own; extra columns are ignored; empty tables give no hits.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.scratch import Scratch
from lexmill.llm.textvec import Words, buffer_of, grams, slices, words
from lexmill.session import ship_code

#: Share of the item's own score for retrieval; share of question and of answer 3-grams for a verified hit.
MATCH, OVERLAP = 0.6, 0.6
#: Words of items in a broadcast index; items of a block; fewest words that are told from ordinary text; shortest length of passages.
SHARD_WORDS, BLOCK, FEW, LEAST = 2_000_000, 8, 5, 32
#: Block maxima looked up at a time.
SCREEN = 2_000_000
K1, B = 1.2, 0.75
SPLIT = np.ones(256, dtype=bool)
SPLIT[128:] = False
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    SPLIT[_a:_b] = False
#: Scripts written without spaces between words, as RE2 names them.
SCRIPTS = ["Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar"]
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def question_answer(text: str) -> tuple[str, str]:
    """An item's question and answer: after its last question mark, else its last sentence, else its second half."""
    q, mark, a = text.rpartition("?")
    if mark and any(map(str.isalnum, a)):
        return q + mark, a
    parts = _SENTENCE.split(text.strip())
    if len(parts) > 1 and len(parts[-1].split()) >= 3:
        return text.strip()[: -len(parts[-1])], parts[-1]
    w = text.split()
    return " ".join(w[: len(w) // 2]), " ".join(w[len(w) // 2 :])


def _words(texts: pa.Array) -> Words:
    texts = pc.utf8_lower(texts.cast(pa.large_string()))
    data, _ = buffer_of(texts)
    if len(data) and int(data.max()) >= 0xE0:  # what SCRIPTS are written in has three bytes at least
        texts = pc.replace_substring_regex(texts, "([" + "".join(rf"\p{{{x}}}" for x in SCRIPTS) + "])", r" \1 ")
    return words(texts, SPLIT)


def _hashes(texts: list[str]) -> list[np.ndarray]:
    w = _words(pa.array(texts, pa.large_string()))
    return [w.hash[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]


def _order(item_id) -> tuple:
    return item_id is not None, item_id or 0


def _grams(h: np.ndarray, k: int = 3) -> np.ndarray:
    return np.unique(grams(SimpleNamespace(hash=h), k))


@dataclass
class Statistics:
    """What BM25 needs of all items: word hashes (sorted), the items that have each, number of items, mean length."""

    terms: np.ndarray
    df: np.ndarray
    n: int
    mean: float

    @classmethod
    def of(cls, every: list[np.ndarray]) -> Statistics:
        terms, df = np.unique(np.concatenate([np.unique(h) for h in every]), return_counts=True)
        return cls(terms, df, len(every), sum(map(len, every)) / len(every))


@dataclass
class Group:
    """Index of the items of one length class."""

    item_id: list
    hashes: list[np.ndarray]
    terms: np.ndarray  # sorted word hashes
    at: np.ndarray  # term -> first posting
    item: np.ndarray
    impact: np.ndarray  # share of the item's own score
    term_max: np.ndarray
    block_at: np.ndarray  # term -> first block
    block: np.ndarray
    block_max: np.ndarray
    essential: np.ndarray
    common: np.ndarray  # most that non-essential terms add, by block
    question: list[tuple[int, np.ndarray]]  # words of a gram and grams
    answer: list[tuple[int, np.ndarray]]
    step: int  # words of half a passage


def _parsed(items: list[tuple[int, str]]) -> list[tuple[int, str, np.ndarray]]:
    texts = [(i, t) for i, t in items if t]
    return [(i, t, h) for (i, t), h in zip(texts, _hashes([t for _, t in texts]) if texts else [], strict=True) if len(h)]


def build_index(items: list[tuple[int, str]], stats: Statistics | None = None) -> list[Group]:
    """One index for each length class of the items. ``stats``: those of all items, if these are but some of them."""
    parsed = _parsed(items)
    if not parsed:
        return []
    stats = stats or Statistics.of([h for *_, h in parsed])
    classes: dict[int, list] = {}
    for x in parsed:
        classes.setdefault(max(LEAST, 1 << (len(x[2]) - 1).bit_length()), []).append(x)
    return [_group(step, sorted(of, key=lambda x: (len(x[2]), _order(x[0]))), stats) for step, of in sorted(classes.items())]


def _group(step: int, items: list, stats: Statistics) -> Group:
    n, length = len(items), np.array([len(h) for *_, h in items])
    terms, where = np.unique(np.concatenate([h for *_, h in items]), return_inverse=True)
    pair, tf = np.unique(where.astype(np.int64) * n + np.repeat(np.arange(n), length), return_counts=True)
    term, item = pair // n, pair % n
    df = stats.df[np.searchsorted(stats.terms, terms)]
    idf = np.log1p((stats.n - df + 0.5) / (df + 0.5))
    impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[item] / stats.mean))
    impact /= np.bincount(item, weights=impact, minlength=n)[item]
    own = np.bincount(term, minlength=len(terms))
    at = np.concatenate(([0], np.cumsum(own)))
    term_max = np.maximum.reduceat(impact, at[:-1])
    # non-essential: the most frequent terms, while no item reaches half the threshold by them
    reach, essential = np.zeros(n), np.ones(len(terms), dtype=bool)
    for t in np.argsort(-own, kind="stable").tolist():
        mine = slice(at[t], at[t + 1])
        if own[t] < 2:
            break
        if (reach[item[mine]] + impact[mine]).max() >= MATCH / 2:
            continue
        reach[item[mine]] += impact[mine]
        essential[t] = False
    blocks = -(-n // BLOCK)
    key, first = np.unique(term * blocks + item // BLOCK, return_index=True)
    common = np.zeros(blocks)
    np.maximum.at(common, np.arange(n) // BLOCK, reach)
    sides = []
    for _, t, h in items:
        qa = _hashes(list(question_answer(t)))
        sides.append([(k := min(3, len(x)), _grams(x, k)) for x in (qa if min(map(len, qa)) else [h, h])])
    block_at = np.searchsorted(key, np.arange(len(terms) + 1) * blocks)
    return Group([i for i, *_ in items], [h for *_, h in items], terms, at, item, impact, term_max, block_at, key % blocks, np.maximum.reduceat(impact, first), essential, common, [q for q, _ in sides], [a for _, a in sides], step)


def wand(g: Group, terms: np.ndarray, least: float) -> list[tuple[int, float]]:
    """(item, score) of all items of which the terms (each once) have a score of ``least`` or more, by block-max WAND."""
    least -= 1e-9
    lists = []  # [item at the cursor, cursor, items, impacts, highest impact, blocks, block maxima]
    for t in terms.tolist():
        a, b, x, y = g.at[t], g.at[t + 1], g.block_at[t], g.block_at[t + 1]
        items = g.item[a:b].tolist()
        lists.append([items[0], 0, items, g.impact[a:b].tolist(), float(g.term_max[t]), g.block[x:y].tolist(), g.block_max[x:y].tolist()])
    out = []

    def forward(some, to):
        for c in some:
            c[1] = bisect_left(c[2], to, c[1])
            c[0] = c[2][c[1]] if c[1] < len(c[2]) else len(g.item_id)

    def at_block(c, b):
        i = bisect_left(c[5], b)
        return c[6][i] if i < len(c[5]) and c[5][i] == b else 0.0

    while True:
        lists = sorted((c for c in lists if c[1] < len(c[2])), key=lambda c: c[0])
        bound, pivot = 0.0, 0
        while pivot < len(lists) and bound < least:
            bound += lists[pivot][4]
            pivot += 1
        if bound < least:
            return out
        item = lists[pivot - 1][0]
        while pivot < len(lists) and lists[pivot][0] == item:
            pivot += 1
        block = item // BLOCK
        if sum(at_block(c, block) for c in lists[:pivot]) < least:  # no item of the block: skip it, but for terms that begin in it
            after = (block + 1) * BLOCK
            forward(lists[:pivot], min(after, lists[pivot][0]) if pivot < len(lists) else after)
        elif lists[0][0] == item:
            score = sum(c[3][c[1]] for c in lists[:pivot])
            if score >= least:
                out.append((item, score))
            forward(lists[:pivot], item + 1)
        else:
            forward([c for c in lists[:pivot] if c[0] < item], item)


def _screened(g: Group, half: np.ndarray, place: np.ndarray, term: np.ndarray) -> np.ndarray:
    """Passages (by their first half) that may hold an item: essential terms' block maxima reach the threshold in some block."""
    hit = np.flatnonzero((term >= 0) & g.essential[term])
    if not len(hit):
        return hit
    v = len(g.terms)
    early = hit[place[hit] > 0]  # also in the passage that begins one half before
    key = np.unique(np.concatenate((half[hit] * v + term[hit], (half[early] - 1) * v + term[early])))
    passage, t = key // v, key % v
    size = g.block_at[t + 1] - g.block_at[t]
    until = np.cumsum(size)
    found = []
    ends = np.append(np.flatnonzero(np.diff(passage)) + 1, len(passage))  # whole passages at a time
    cuts = np.unique(np.append(ends[np.unique(until[ends - 1] // SCREEN, return_index=True)[1]], len(passage)))
    for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True):
        n = size[a:b]
        at = np.repeat(g.block_at[t[a:b]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        at_block = np.repeat(passage[a:b], n) * len(g.common) + g.block[at]
        pairs, which = np.unique(at_block, return_inverse=True)
        bound = np.bincount(which, weights=g.block_max[at]) + g.common[pairs % len(g.common)]
        found.append(np.unique(pairs[bound >= MATCH - 1e-6] // len(g.common)))
    return np.concatenate(found)


def search(index: list[Group], texts: pa.Array) -> list[tuple[int, int, float, float, float]]:
    """(row, item_id, score, question overlap, answer overlap) of verified hits, best passage of each text and item."""
    w = _words(texts)
    out: dict[tuple[int, int], tuple[float, float, float]] = {}
    if not len(w.hash):
        return []
    n = np.diff(w.first)
    doc = np.repeat(np.arange(len(n)), n)
    for g in index:
        i = np.minimum(np.searchsorted(g.terms, w.hash), len(g.terms) - 1)
        term = np.where(g.terms[i] == w.hash, i, -1)
        place = (np.arange(len(w.hash)) - w.first[doc]) // g.step
        base = np.concatenate(([0], np.cumsum(n // g.step + 1)))  # half-passages of each text
        for p in _screened(g, base[doc] + place, place, term).tolist():
            d = int(np.searchsorted(base, p, side="right") - 1)
            a = int(w.first[d] + (p - base[d]) * g.step)
            b = min(a + 2 * g.step, int(w.first[d + 1]))
            t = np.unique(term[a:b])
            have: dict[int, np.ndarray] = {}
            for j, score in wand(g, t[t >= 0], MATCH):
                if len(g.hashes[j]) < FEW and not np.array_equal(w.hash[w.first[d] : w.first[d + 1]], g.hashes[j]):
                    continue
                share = []
                for k, x in (g.question[j], g.answer[j]):
                    if k not in have:
                        have[k] = _grams(w.hash[a:b], k)
                    share.append(float(np.isin(x, have[k]).mean()))
                if min(share) >= OVERLAP:
                    now = (score, *share)
                    out[d, g.item_id[j]] = max(out.get((d, g.item_id[j]), now), now)
    return [(d, i, *x) for (d, i), x in sorted(out.items(), key=lambda x: (x[0][0], _order(x[0][1])))]


def _item_terms(shards: int):
    """(shard, word hash as long, length or null): an item's length stands in its first row."""

    def run(batches):
        for batch in batches:
            for s, (_, _, h) in ((s, x) for i, t, s in zip(*(batch.column(c).to_pylist() for c in ("item_id", "text", "shard")), strict=True) for x in _parsed([(i, t)])):
                own = np.unique(h).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([s] * len(own), pa.int64()), pa.array(own), pa.array([len(h)] + [None] * (len(own) - 1), pa.int64())], names=["shard", "h", "length"])

    return run


def _items(spark: SparkSession, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(item_id, text) of distinct texts, under numbers of their own, and (number, item_id) of all rows: however often a text comes,
    an index holds it once."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    scratch = Scratch(spark, "items")
    once = scratch.save(rows.select("text").distinct().select(F.monotonically_increasing_id().alias("item_id"), "text"), "distinct")
    return once, once.select(F.col("item_id").alias("number"), "text").join(rows, "text").select("number", "item_id").distinct()


def _indexes(spark: SparkSession, items: DataFrame):
    """Broadcasts of the index, ``SHARD_WORDS`` words of items at a time; statistics are those of all distinct items."""
    rows, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    if not rows:
        return
    shards = -(-(int(size) // 4 + rows) // SHARD_WORDS)
    items = items.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)))
    stats = None
    if shards > 1:
        terms = items.mapInArrow(_item_terms(shards), "shard long, h long, length long")
        n, mean = terms.agg(F.count("length"), F.avg("length")).first()
        every = terms.groupBy("h").agg(F.count("*").alias("df"))
    for s in range(shards):
        if shards > 1:
            mine = every.join(terms.where(F.col("shard") == s).select("h").distinct(), "h", "left_semi").toArrow()
            h, df = (mine.column(c).to_numpy() for c in ("h", "df"))
            by = np.argsort(h.view(np.uint64))
            stats = Statistics(h.view(np.uint64)[by], df[by], n, mean)
        found = items.where(F.col("shard") == s).collect()
        if index := build_index(sorted(((r["item_id"], r["text"]) for r in found), key=lambda x: (_order(x[0]), x[1])), stats):
            yield spark.sparkContext.broadcast(index)


def _hits(index):
    def run(batches):
        for batch in batches:
            for a, texts in slices(batch.column("text")):
                found = search(index.value, texts)
                ids = batch.column("doc_id").slice(a, len(texts)).to_pylist()
                cols = list(zip(*[(ids[d], *x) for d, *x in found], strict=True)) if found else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()), strict=True)], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

    return run


def contamination(spark: SparkSession, documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap for every verified hit."""
    ship_code(spark)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    out, (items, names) = None, _items(spark, benchmark)
    for index in _indexes(spark, items):
        hits = docs.mapInArrow(_hits(index), schema)
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        return spark.createDataFrame([], schema)
    return out.withColumnRenamed("item_id", "number").join(names, "number").select(*[x.split()[0] for x in schema.split(", ")])


def _clean(index):
    def run(batches):
        for batch in batches:
            bad = np.zeros(len(batch), dtype=bool)
            for a, texts in slices(batch.column("text")):
                bad[[a + d for d, *_ in search(index.value, texts)]] = True
            yield batch.filter(pa.array(~bad))

    return run


def decontaminate(spark: SparkSession, documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without those that hold a test item; all columns stay."""
    ship_code(spark)
    for index in _indexes(spark, _items(spark, benchmark)[0]):
        documents = documents.mapInArrow(_clean(index), documents.schema)
    return documents
