"""LM scoring: a causal self-attention model over subword ids, trained in numpy on the corpus.

Texts are cut into marked words (an optional space and a run of other characters; any other white space stands alone) and each
word into ids of a public byte-level vocabulary; an end id closes the text. Every text is segmented once: its ids, and the counts
that its words need, are written in rows of about ``STRETCH`` bytes of text, whatever the number of texts in them.

Model. Every id has an embedding: the leading components of what follows it in the training texts. One head of causal
self-attention (queries, keys, values, a residual map, a bias by distance) over these embeddings predicts the next id by a tree
of three levels: group of classes, class within the group, id within the class. The first two have trained output weights, added to
the counted logits given the class before; frequent ids are classes of their own. The ids of a shared class are told apart by their
counts after the class before, smoothed. Every level sums to one, so all ids together do.

Scoring cuts a text's ids into blocks; a window is a block and the block before it as context, windows overlap by that block,
and each id is scored once, in batched masked attention. A passage is a run of ids that ends where the ids themselves say (one
place in 32 on average), so copies have equal passages wherever they stand. Its probability is a mixture of the attention's
and of its share in the training texts, own text left out (``MEMORY``), so what the model knows grows with the corpus.

What is learned: counts of words, passages, ids and pairs of classes in all training texts (those whose crc32 of the id, as
text, modulo 10 is not 0), by Spark aggregation; the weights by one data-parallel pass over all training windows in ``PHASES``
parts, each partition training from the same weights and all results averaged. Nothing is sampled.

Counts of words and passages are exact: each row's distinct hashes, in an order by which parts are ranges, go to their parts, are
summed, and come back to the row in the same order; memory holds one row, or one part of about ``PART`` hashes.

Edge cases: a null or empty text is the end token alone; a null doc_id is the text "null" for the hold-out; repeated rows are
counted and scored each; a text longer than ``STRETCH`` is a row of its own; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import ctypes
import math
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.scratch import Scratch
from lexmill.llm.textvec import SPACE, _power, buffer_of, mix, slices, words

#: Ids of a block; groups, classes of a group, width of the model; smoothing of counts.
BLOCK, GROUPS, MEMBERS, WIDTH, SMOOTH = 16, 8, 32, 24, 0.1
CLASSES = GROUPS * MEMBERS
#: Columns of a state with its logits of groups; products of this width are the quicker ones.
WIDE = WIDTH + GROUPS
#: Classes that rare ids share, by frequency.
SHARED = 24
#: Parts of the training pass; blocks of a gradient step, and in sequence in it; bytes of text in a row; hashes in a part.
PHASES, STEP, RUN, STRETCH, PART = 4, 256, 16, 4 << 20, 4_000_000
#: Size of a gradient step at first, which falls with the square root of the steps and by the parts of the pass; share of a step's
#: weights in the average.
RATE, AVERAGE = 0.004, 0.005
#: Averages of weights that reach the driver at most.
AVERAGES = 32
#: Weight of the class's own distribution against what the class before says; of an id's mean continuation.
BACKOFF = 4.0
#: Weight of the passages of other texts; one place in this many ends a passage.
MEMORY, PASSAGE = 0.05, 32
#: Words whose ids a worker keeps.
TABLE_LIMIT = 800_000
_LIMIT, _ONES = np.float32(60), np.ones(max(2 * BLOCK, GROUPS, MEMBERS), dtype=np.float32)
#: Hashes of passages have the first bit, those of words do not.
_IS_PASSAGE = np.uint64(1 << 63)
_loaded: dict[str, Subwords] = {}


class Subwords:
    """Ids of marked words by hash, kept in bounded sorted tables. Bytes that are no character are their bytes' ids."""

    def __init__(self, ranks_path: str):
        import base64

        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_path, "rb"))}
        self.size, self.end = len(ranks) + 1, len(ranks)
        self.enc = tiktoken.Encoding("subwords", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.line = ranks[b"\n"]
        self.tables = [_table(), _table()]  # all known words, and those added lately

    @classmethod
    def load(cls, path: str) -> Subwords:
        if path not in _loaded:
            _loaded[path] = cls(path)
        return _loaded[path]

    def encode_word(self, w: bytes) -> np.ndarray:
        out: list[int] = []
        for i in range(0, len(w), 256):  # long runs are cut so that segmentation stays linear
            part = w[i : i + 256]
            try:
                out += self.enc.encode_ordinary(part.decode())
            except UnicodeDecodeError:  # the cut fell within a character
                out += [self.enc.encode_single_token(part[j : j + 1]) for j in range(len(part))]
        return np.array(out, dtype=np.int32)

    def encode_plain(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in order, number of ids of each). Words are encoded together, a line each: a line end is an id of its own."""
        size = end - start + 1
        stop = np.cumsum(size)
        lines = raw.take(np.repeat(start - stop + size, size) + np.arange(stop[-1]), mode="clip")
        lines[stop - 1] = 10
        ids = np.array(self.enc.encode_ordinary(lines.tobytes().decode()), dtype=np.int32)
        line = np.flatnonzero(ids == self.line)
        if len(line) != len(size):  # a word ends in white space of another kind, which has run together with a line end
            found = [self.encode_word(raw[a:b].tobytes()) for a, b in zip(start.tolist(), end.tolist(), strict=True)]
            return np.concatenate(found), np.array([len(x) for x in found])
        return np.delete(ids, line), np.diff(line, prepend=-1) - 1

    def ids(self, key: np.ndarray, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat ids, begin, size) of distinct words, given by hash and place."""
        at, size, flat = np.empty(len(key), dtype=np.int64), np.empty(len(key), dtype=np.int64), []
        open_, base = np.ones(len(key), dtype=bool), 0
        for h, b, n, f in self.tables:
            if len(h):
                i = np.minimum(np.searchsorted(h, key), len(h) - 1)
                hit = (h[i] == key) & open_
                at[hit], size[hit] = b[i[hit]] + base, n[i[hit]]
                open_ &= ~hit
            flat.append(f)
            base += len(f)
        odd = (end - start > 256) | (end - start == 1) & SPACE[raw[start]]
        plain, odd = np.flatnonzero(open_ & ~odd), np.flatnonzero(open_ & odd)
        found = [self.encode_plain(raw, start[plain], end[plain])] if len(plain) else []
        found += [(x, np.array([len(x)])) for x in (self.encode_word(raw[start[i] : end[i]].tobytes()) for i in odd.tolist())]
        if found:
            new = np.concatenate((plain, odd))
            f, n = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
            b = np.cumsum(n) - n
            at[new], size[new] = b + base, n
            flat.append(f)
            self._add(_table(key[new], b, n, f))
        return np.concatenate(flat), at, size

    def _add(self, late) -> None:
        known, recent = self.tables
        recent = _merged(recent, late)
        if len(recent[0]) * 4 > len(known[0]):
            known, recent = (recent if len(known[0]) > TABLE_LIMIT else _merged(known, recent)), _table()
        self.tables = [known, recent]

    def sequences(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts, an end id after each, and where each text begins (one more at the end)."""
        w = words(texts, fold=False)
        _, off = buffer_of(texts)
        begins = np.zeros(len(w.data) + 1, dtype=bool)
        begins[off] = True
        lead = (w.start > 0) & ~begins[w.start]
        lead[lead] = w.data[w.start[lead] - 1] == 32
        lone = SPACE[w.data]
        lone[w.start[lead] - 1] = False
        starts = lone.copy()
        starts[w.start - lead] = True
        start = np.flatnonzero(starts)
        alone = lone[start]
        key, end = np.empty(len(start), dtype=np.uint64), start + 1
        key[alone] = w.data[start[alone]]
        key[~alone] = w.hash ^ lead.astype(np.uint64)
        end[~alone] = w.end
        which, distinct, first = distinct_of(key)
        flat, at, size = self.ids(distinct, w.data, start[first], end[first])
        n = size[which]
        before = np.concatenate(([0], np.cumsum(n)))
        ids = flat[np.repeat(at[which] - before[:-1], n) + np.arange(before[-1])]
        cut = before[np.searchsorted(start, off)]
        out = np.insert(ids, cut[1:], self.end)
        return out, cut + np.arange(len(cut))


def _table(h=(), begin=(), size=(), flat=()):
    by = np.argsort(np.asarray(h, dtype=np.uint64))
    return np.asarray(h, np.uint64)[by], np.asarray(begin, np.int32)[by], np.asarray(size, np.int32)[by], np.asarray(flat, np.int32)


def _merged(a, b):
    return _table(np.concatenate((a[0], b[0])), np.concatenate((a[1], b[1] + len(a[3]))), np.concatenate((a[2], b[2])), np.concatenate((a[3], b[3])))


def distinct_of(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which distinct value each is, the distinct values by first occurrence, their first places)."""
    found = pc.dictionary_encode(pa.array(key))
    which = found.indices.to_numpy().astype(np.int64)
    top = np.maximum.accumulate(which) if len(which) else which
    return which, found.dictionary.to_numpy(), np.flatnonzero(np.diff(top, prepend=-1))


def stops(ids: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin of each passage and the end of the last, a hash of every id). Two ids in sequence say whether a passage ends, and the end
    of a text does."""
    if not len(ids):
        return np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    one = mix(np.arange(1, int(ids.max()) + 2, dtype=np.uint64)).take(ids)
    pair = one.copy()
    pair[1:] += one[:-1] * np.uint64(31)
    pair[begin[:-1]] = one[begin[:-1]]
    last = mix(pair) & np.uint64(PASSAGE - 1) == 0  # PASSAGE is a power of two
    last[begin[1:] - 1] = True
    return np.concatenate(([0], np.flatnonzero(last) + 1)), one


def passages(ids: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin of each passage, hash of its ids)."""
    at, one = stops(ids, begin)
    up, down = _power(len(ids) + 1)
    run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(one * up[: len(ids)])))
    return at[:-1], mix((run[at[1:]] - run[at[:-1]]) * down[at[:-1]]) | _IS_PASSAGE


class Attention:
    """One head of causal self-attention over embeddings; trained weights in one flat vector.

    ``embedding`` (ids + 1, WIDTH), the last row for no id; ``before`` (CLASSES + 1, CLASSES) the counted logits of classes.
    Inputs come in runs (runs, blocks + 1, BLOCK) of ids: every block but the first has the block before it as context. The head is
    as wide as the embedding, so queries times keys is one matrix ("a") between embeddings, and values are a matrix ("v") times the
    embeddings that the attention sums.
    """

    def __init__(self, embedding: np.ndarray, before: np.ndarray, flat: np.ndarray | None = None):
        d = WIDTH
        self.wide = np.zeros((len(embedding), WIDE), dtype=np.float32)
        self.wide[:, :d], self.wide[:, d] = embedding, 1  # a one, with which the attention also sums its weights
        self.before = before.reshape(-1, MEMBERS).astype(np.float32)
        self.before_group = np.logaddexp.reduce(before.reshape(-1, GROUPS, MEMBERS), axis=2).astype(np.float32)
        self.shapes = {"a": (d, 2 * d), "v": (d, d), "r": (2 * BLOCK,), "g": (d, GROUPS), "m": (GROUPS, d, MEMBERS)}  # a: scores, residual
        self.flat = np.zeros(sum(int(np.prod(s)) for s in self.shapes.values()), dtype=np.float32) if flat is None else flat.astype(np.float32)
        self.p = self.views(self.flat)
        if flat is None:
            rng = np.random.default_rng(11)
            for k in "av":
                self.p[k][:] = rng.normal(0, d**-0.5, self.shapes[k])
            self.p["a"][:, :d] *= d**-0.5
            for k in "gm":
                self.p[k][:] = rng.normal(0, 0.02, self.shapes[k])
        q, k = np.arange(BLOCK)[:, None] + BLOCK, np.arange(2 * BLOCK)[None, :]
        self.distance = np.clip(q - k, 0, 2 * BLOCK - 1)
        self.mask = (k <= q).astype(np.float32)
        self._looked_up = None

    def views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for k, s in self.shapes.items():
            n = math.prod(s)
            out[k] = flat[at : at + n].reshape(s)
            at += n
        return out

    def looked_up(self) -> tuple[np.ndarray, np.ndarray]:
        """Query and residual of every id, for the present weights."""
        if self._looked_up is None or not np.array_equal(self._looked_up[0], self.flat):
            own = self.wide[:, :WIDTH] @ self.p["a"]
            self._looked_up = self.flat.copy(), tuple(map(np.ascontiguousarray, np.split(own, 2, axis=1)))
        return self._looked_up[1]

    def sums(self, x: np.ndarray, query):
        """What the attention sums for all but the first block of every run (WIDTH columns are used), given a function from embeddings to
        queries, and what the gradient needs."""
        d, (runs, n, _) = WIDTH, x.shape
        e = self.wide.take(x.ravel(), axis=0).reshape(runs, n * BLOCK, WIDE)
        f, ft = _windows(e, n), _windows(np.ascontiguousarray(e[:, :, : d + 1].swapaxes(1, 2)), n, across=True)
        e = e[:, BLOCK:, :d]
        s = query(e)[..., :d].reshape(runs, n - 1, BLOCK, d) @ ft[:, :, :d]
        np.exp(_bounded(s), out=s)
        s *= np.exp(np.minimum(self.p["r"], _LIMIT / 3))[self.distance] * self.mask
        seen = (s @ f).reshape(-1, WIDE)
        part = 1 / seen[:, d]
        seen *= part[:, None]  # rather than s, which is larger
        return seen.reshape(runs, -1, WIDE), (e, f, ft, s, part)

    @staticmethod
    def level(z: np.ndarray):
        """Exponentials of the logits z, in place, and their sums."""
        np.exp(_bounded(z), out=z)
        return z, z @ _ONES[: z.shape[1]]

    @staticmethod
    def chosen(z: np.ndarray, sums: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Log-probabilities at flat places, one in each row."""
        return np.log(z.ravel().take(at)) - np.log(sums)

    def tree(self, h: np.ndarray, z: np.ndarray, c: np.ndarray, y: np.ndarray):
        """Logits of both levels and the flat places of the classes y, given the classes c before them, states h and their own logits z of
        groups; at the second level, tokens are in order of their groups."""
        y = y.astype(np.int32)
        group = y // MEMBERS
        z = z + self.before_group.take(c, axis=0)
        by = np.argsort(group.astype(np.uint8), kind="stable")
        cut = np.searchsorted(group.take(by), np.arange(GROUPS + 1)).tolist()
        hs = h.take(by, axis=0)[:, :WIDTH]
        zs = self.before.take((c * GROUPS + group).take(by), axis=0)
        for g, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
            zs[a:b] += hs[a:b] @ self.p["m"][g]
        row = np.arange(len(y))
        return by, cut, hs, z, row * GROUPS + group, zs, row * MEMBERS + (y - group * MEMBERS).take(by)

    def score(self, x: np.ndarray, c: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Log-probabilities of the classes y, given the classes c before them, of all but the first block of every run x."""
        own = x[:, 1:].ravel()
        query, h = self.looked_up()
        seen, _ = self.sums(x, lambda _: query.take(own, axis=0))
        h = h.take(own, axis=0)
        h += seen.reshape(-1, WIDE)[:, :WIDTH] @ self.p["v"]
        by, _, _, z, at, zs, inner = self.tree(h, h @ self.p["g"], c, y)
        out = self.chosen(*self.level(z), at)
        out[by] += self.chosen(*self.level(zs), inner)
        return out

    def gradient(self, x: np.ndarray, c: np.ndarray, y: np.ndarray, with_loss: bool = True) -> tuple[np.ndarray, float]:
        """Gradient of the mean loss for targets y (-1: none), and that loss (0 unless asked for)."""
        d = WIDTH
        p = self.p
        a = np.zeros((d, WIDE), dtype=np.float32)
        a[:, :d] = p["a"][:, :d]
        seen, (e, f, ft, s, part) = self.sums(x, lambda e: e @ a)
        summed = np.concatenate((p["v"], p["v"] @ p["g"]), axis=1)
        h = e @ np.concatenate((p["a"][:, d:], p["a"][:, d:] @ p["g"]), axis=1)
        h += seen[:, :, :d] @ summed
        h = h.reshape(-1, WIDE)
        out = np.empty_like(self.flat)
        g = self.views(out)
        real = y >= 0
        weight = (real / np.float32(max(1, int(real.sum())))).astype(np.float32)
        by, cut, hs, z, at, zs, inner = self.tree(h, h[:, d:], c, np.maximum(y, 0))
        loss = 0.0
        for a, place, share in ((z, at, weight), (zs, inner, weight.take(by))):
            _, sums = self.level(a)
            if with_loss:
                loss -= float(self.chosen(a, sums, place) @ share)
            a *= (share / sums)[:, None]
            a.reshape(-1)[place] -= share
        m = np.zeros((GROUPS, MEMBERS, WIDE), dtype=np.float32)
        m[:, :, :d] = p["m"].swapaxes(1, 2)
        dhs = np.empty((len(hs), WIDE), dtype=np.float32)
        for j, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
            g["m"][j] = hs[a:b].T @ zs[a:b]
            np.matmul(zs[a:b], m[j], out=dhs[a:b])
        back = np.empty_like(by)
        back[by] = np.arange(len(by))
        dh = dhs.take(back, axis=0)  # of the second level; the first one's logits stand beside
        dh[:, d:] = z
        dh = dh.reshape(*seen.shape[:2], WIDE)
        across = np.zeros((WIDE, WIDE), dtype=np.float32)
        across[:, :d] = summed.T
        dseen = (dh @ across).reshape(-1, WIDE)
        dseen *= part[:, None]
        dseen[:, d] = -np.einsum("ab,ab->a", dseen, seen.reshape(-1, WIDE))
        ds = dseen[:, : d + 1].reshape(*s.shape[:3], d + 1) @ ft
        ds *= s
        g["r"][:] = np.bincount(self.distance.ravel(), weights=ds.sum(axis=(0, 1)).ravel(), minlength=2 * BLOCK)
        g["a"][:, :d] = _across(e, (ds @ f).reshape(dh.shape))[:, :d]
        of_e, of_seen = _across(e, dh), _across(seen[:, :, :d], dh)
        g["a"][:, d:] = of_e[:, :d] + of_e[:, d:] @ p["g"].T
        g["v"][:] = of_seen[:, :d] + of_seen[:, d:] @ p["g"].T
        g["g"][:] = p["a"][:, d:].T @ of_e[:, d:] + p["v"].T @ of_seen[:, d:]
        return out, loss


def _bounded(z: np.ndarray) -> np.ndarray:
    """z between the limits, in place. Most often it is, and looking is cheaper than writing."""
    if z.size and not (z.max() <= _LIMIT and z.min() >= -_LIMIT):
        np.clip(z, -_LIMIT, _LIMIT, out=z)
    return z


def _across(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum of a.T @ b over runs."""
    return (a.swapaxes(1, 2) @ b).sum(axis=0)


def _windows(a: np.ndarray, n: int, across: bool = False) -> np.ndarray:
    """Every block but the first with the block before it, along the second axis or the last one, without a copy."""
    run, row, one = a.strides
    if across:
        return np.lib.stride_tricks.as_strided(a, (len(a), n - 1, a.shape[1], 2 * BLOCK), (run, one * BLOCK, row, one), writeable=False)
    return np.lib.stride_tricks.as_strided(a, (len(a), n - 1, 2 * BLOCK, a.shape[2]), (run, row * BLOCK, row, one), writeable=False)


def is_held(ids: list) -> np.ndarray:
    return np.array([crc32(("null" if i is None else str(i)).encode()) % 10 == 0 for i in ids], dtype=bool)


def _row(**columns) -> pa.RecordBatch:
    arrays = {k: pa.array([v.tobytes() if isinstance(v, np.ndarray) else v], pa.binary() if isinstance(v, np.ndarray | bytes) else pa.int32() if k == "phase" else pa.int64()) for k, v in columns.items()}
    return pa.RecordBatch.from_arrays(list(arrays.values()), names=list(arrays))


#: Rows of ids (phase 0 and up): ids, begin, held. A row of counts (phase -1): distinct ids and their counts in training texts, and the rest.
ENCODED = "bucket long, phase int, ids binary, begin binary, held binary, doc_id binary, known binary, n_words binary, hash binary, n binary, word binary, passage binary, per_text binary, n_hash long, train_words long, train_passages long, train_texts long"


def _encode(ranks: str):
    """A row of counts (phase -1) and ``PHASES`` rows of ids for each stretch of texts."""
    blank = dict.fromkeys((c.split()[0] for c in ENCODED.split(", ")), b"") | dict.fromkeys(("n_hash", "train_words", "train_passages", "train_texts"), 0)

    def run(batches):
        sub, bucket = Subwords.load(ranks), TaskContext.get().partitionId() << 32
        small = _small(sub.size)
        for batch in batches:
            for a, texts in slices(batch.column("text"), STRETCH):
                docs = batch.column("doc_id").slice(a, len(texts)).to_pylist()
                held = is_held(docs)
                w = words(texts)
                n = np.diff(w.first)
                ids, begin = sub.sequences(texts)
                start, h = passages(ids, begin)
                per_text = np.diff(np.searchsorted(start, begin))
                which, distinct, _ = distinct_of(np.concatenate((w.hash & ~_IS_PASSAGE, h)))
                by = np.argsort(mix(distinct))
                rank = np.empty(len(by), dtype=np.uint32)
                rank[by] = np.arange(len(by))
                which = rank[which]
                train = np.concatenate((np.repeat(~held, n), np.repeat(~held, per_text)))
                count = np.bincount(which[train], minlength=len(by)).astype(np.uint32)
                id_count = np.bincount(ids[np.repeat(~held, np.diff(begin))], minlength=sub.size)
                own = np.flatnonzero(id_count)
                yield _row(**blank | dict(bucket=bucket, phase=-1, ids=own.astype(small), begin=id_count[own], held=held, doc_id=np.array([x or 0 for x in docs], dtype=np.int64), known=np.array([x is not None for x in docs]), n_words=n, hash=distinct[by], n=count, word=planes(which[: len(w.hash)]), passage=planes(which[len(w.hash) :]), per_text=per_text, n_hash=len(distinct), train_words=int(n[~held].sum()), train_passages=int(per_text[~held].sum()), train_texts=int((~held).sum())))
                cut = np.searchsorted(begin, np.linspace(0, len(ids), PHASES + 1)[1:-1])
                for p, (x, y) in enumerate(zip([0, *cut.tolist()], [*cut.tolist(), len(held)], strict=True)):
                    if y > x:
                        yield _row(**blank | dict(bucket=bucket, phase=p, ids=ids[begin[x] : begin[y]].astype(small), begin=begin[x : y + 1] - begin[x], held=held[x:y]))
                bucket += 1

    return run


def planes(x: np.ndarray) -> np.ndarray:
    """Numbers below 2**32 as bytes, all lowest ones first, which a codec packs better."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T)


def unplanes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _small(size: int):
    return np.min_scalar_type(size - 1)


def _arrays(batches, **types):
    """Rows as dicts of arrays, or plain numbers where the type is None."""
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in types), strict=True):
            yield {c: x if t is None else np.frombuffer(x, dtype=t) for (c, t), x in zip(types.items(), row, strict=True)}


def _send(parts: int):
    """Hashes and counts of a row, by part: a range of the order they are in."""

    def run(batches):
        for r in _arrays(batches, bucket=None, hash=np.uint64, n=np.uint32):
            h, n = r["hash"], r["n"]
            part = ((mix(h) >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
            cut = np.searchsorted(part, np.arange(parts + 1).astype(np.uint64))
            some = np.flatnonzero(np.diff(cut)).tolist()
            ends = [(int(cut[p]), int(cut[p + 1])) for p in some]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([r["bucket"]] * len(some), pa.int64()), pa.array([h[a:b].tobytes() for a, b in ends], pa.binary()), pa.array([n[a:b].tobytes() for a, b in ends], pa.binary())], names=["part", "bucket", "h", "n"])

    return run


def _total(batches):
    """Counts of a part's hashes over all rows, in the order they came from each row: (bucket, part, c); and the number of the
    part's words that training texts have (bucket -1)."""
    now, held = None, []

    def out():
        h, n = (np.concatenate([r[x] for r in held]) for x in ("h", "n"))
        which, distinct, _ = distinct_of(h)
        c = np.bincount(which, weights=n, minlength=len(distinct)).astype("<i8")
        known = int(((c > 0) & (distinct < _IS_PASSAGE)).sum())
        c = c[which]
        ends = np.cumsum([len(r["h"]) for r in held]).tolist()
        each = [c[a:b].tobytes() for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([*(r["bucket"] for r in held), -1], pa.int64()), pa.array([now] * (len(held) + 1), pa.int64()), pa.array([*each, None], pa.binary()), pa.array([0] * len(held) + [known], pa.int64())], names=["bucket", "part", "c", "known"])

    for r in _arrays(batches, part=None, bucket=None, h=np.uint64, n=np.uint32):
        if r["part"] != now and held:
            yield out()
            held = []
        now = r["part"]
        held.append(r)
    if held:
        yield out()


def _packed(n: np.ndarray, first: int = 0) -> pa.RecordBatch:
    at = np.flatnonzero(n)
    return pa.RecordBatch.from_arrays([pa.array(at + first), pa.array(n[at].astype(np.int64))], names=["id", "n"])


def _encoded(batches, size: int):
    """(ids, begin, training texts) of rows of ids."""
    for r in _arrays(batches, ids=_small(size), begin=np.int64, held=bool):
        yield r["ids"].astype(np.int64), r["begin"], ~r["held"]


def _id_counts(size: int):
    """Sum of the rows' counts of ids."""

    def run(batches):
        n = np.zeros(size, dtype=np.int64)
        for r in _arrays(batches, ids=_small(size), begin=np.int64):
            n[r["ids"]] += r["begin"]
        yield _packed(n)

    return run


def _pair_counts(size: int, classes):
    """Counts over the training texts: (class before, class), then (class before, id) and (id, class after) of the ids of shared classes."""

    def run(batches):
        cls, many = classes.value, CLASSES - SHARED
        between = np.zeros((CLASSES + 1) * CLASSES, dtype=np.int64)
        pairs, after = np.zeros((CLASSES + 1) * size, dtype=np.uint32), np.zeros(size * CLASSES, dtype=np.uint32)
        for ids, begin, train in _encoded(batches, size):
            c = cls[ids]
            b = before(c, begin)
            real = np.repeat(train, np.diff(begin))
            between += np.bincount((b * CLASSES + c)[real], minlength=len(between))
            at = np.flatnonzero(real & (c >= many))
            np.add.at(pairs, b[at] * size + ids[at], 1)
            at = np.flatnonzero(real & (b >= many) & (b < CLASSES))
            np.add.at(after, ids[at - 1] * CLASSES + c[at], 1)
        yield _packed(between)
        yield _packed(pairs, len(between))
        yield _packed(after, len(between) + len(pairs))

    return run


def pair_tables(counts: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class before, id) and (id, class after) of all ids, from what ``_pair_counts`` found."""
    size = len(cls)
    between, pairs, after = np.split(counts, np.cumsum([(CLASSES + 1) * CLASSES, (CLASSES + 1) * size]))
    between, pairs, after = between.reshape(-1, CLASSES), pairs.reshape(-1, size), after.reshape(size, -1)
    alone = np.flatnonzero(cls < CLASSES - SHARED)
    pairs[:, alone], after[alone] = between[:, cls[alone]], between[cls[alone]]
    return pairs, after


def before(cls: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The class before each id; CLASSES at the beginning of a text."""
    out = np.empty(len(cls), dtype=np.int64)
    out[1:] = cls[:-1]
    out[begin[:-1]] = CLASSES
    return out


def classes_of(counts: np.ndarray) -> np.ndarray:
    """Class of every id: frequent ids alone, the others by frequency."""
    order = np.argsort(-counts, kind="stable")
    cls = np.empty(len(counts), dtype=np.int64)
    single = CLASSES - SHARED
    cls[order[:single]] = np.arange(single)
    rest = order[single:]
    mass = np.cumsum(counts[rest] + SMOOTH)
    cls[rest] = single + np.minimum(SHARED - 1, (mass / mass[-1] * SHARED).astype(np.int64))
    return cls


def grouped(between: np.ndarray) -> np.ndarray:
    """New number of every class, so that classes that follow the same classes share a group: balanced cuts along the main direction."""
    share = np.sqrt((between + SMOOTH) / (between + SMOOTH).sum(axis=0)).T  # class x class before
    parts = [np.arange(CLASSES)]
    while len(parts) < GROUPS:
        halves = []
        for part in parts:
            x = share[part] - share[part].mean(axis=0)
            along = x @ np.linalg.eigh(x.T @ x)[1][:, -1]
            order = part[np.argsort(along, kind="stable")]
            halves += [order[: len(order) // 2], order[len(order) // 2 :]]
        parts = halves
    new = np.empty(CLASSES, dtype=np.int64)
    new[np.concatenate(parts)] = np.arange(CLASSES)
    return new


def embeddings(after: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Leading components of the square roots of every id's continuation shares; a row of zeros for no id."""
    mean = after.sum(axis=0, dtype=np.float64) + SMOOTH
    x = after.astype(np.float32)
    x += BACKOFF * (mean / mean.sum()).astype(np.float32)
    x /= x.sum(axis=1, keepdims=True)
    np.sqrt(x, out=x)
    x -= np.sqrt(mean / mean.sum()).astype(np.float32)
    weight = (counts / max(1, counts.sum())).astype(np.float32)
    main = np.linalg.eigh((x * weight[:, None]).T @ x)[1][:, : -WIDTH - 1 : -1].astype(np.float32)
    e = x @ main
    e *= 2 / np.sqrt((weight[:, None] * e * e).sum(axis=0) + 1e-6)
    return np.concatenate((np.clip(e, -6, 6), np.zeros((1, WIDTH), np.float32)))


class Vocabulary:
    """Class of every id, log-probabilities within the class given the class before, embeddings and class logits; of fixed size."""

    def __init__(self, counts: np.ndarray, cls: np.ndarray, pairs: np.ndarray, after: np.ndarray):
        between = lambda: np.stack([np.bincount(cls, weights=row, minlength=CLASSES) for row in pairs])
        new = grouped(between()[:CLASSES])
        old = np.argsort(new)
        cls, pairs, after = new[cls], pairs[[*old, CLASSES]], after[:, old]
        alone = counts + SMOOTH
        alone = (alone / np.bincount(cls, weights=alone, minlength=CLASSES)[cls]).astype(np.float32)
        self.cls = cls
        in_class = np.stack([np.bincount(cls, weights=row, minlength=CLASSES) for row in pairs]).astype(np.float32)
        self.table = pairs.astype(np.float32)
        self.table += BACKOFF * alone
        for row, total in zip(self.table, in_class, strict=True):
            row /= total[cls] + BACKOFF
        np.log(self.table, out=self.table)
        members = np.bincount(cls, minlength=CLASSES)
        self.shared = members > 1
        smooth = np.where(members > 0, in_class + SMOOTH, 1e-35)  # a class without ids gets nothing
        self.before = np.log(smooth / smooth.sum(axis=1, keepdims=True))
        self.embedding = embeddings(after, counts)

    def within(self, c: np.ndarray, ids: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """Log-probability of ids within their classes, given the classes before; 0 for no id."""
        out = np.zeros(len(ids))
        some = np.flatnonzero(np.append(self.shared, False).take(cls))
        out[some] = self.table.ravel().take(c.take(some).astype(np.int64) * len(self.cls) + ids.take(some))
        return out


def _keep_freed_memory() -> None:
    """Small steps allocate and free the same arrays all the time: let the C library keep up to 64 MB of them."""
    if mallopt := getattr(ctypes.CDLL(None), "mallopt", None):
        mallopt(-3, 64 << 20)  # M_MMAP_THRESHOLD
        mallopt(-1, 64 << 20)  # M_TRIM_THRESHOLD


class Inputs:
    """Texts in blocks of inputs, and the ids that follow these inputs.

    Every text begins with a block of no ids and is filled up to whole blocks, so each block's context is the block before it.
    """

    def __init__(self, vocabulary: Vocabulary, ids: np.ndarray, begin: np.ndarray, take: np.ndarray):
        n = np.diff(begin)
        room = np.where(take, (-(-n // BLOCK) + 1) * BLOCK, 0)
        place = np.cumsum(room) - room + BLOCK
        self.none, size = len(vocabulary.cls), int(room.sum())  # none stands for no id
        own = np.repeat(take, n)
        at = np.arange(len(ids))[own] + np.repeat(place - begin[:-1], n)[own]
        last = np.zeros(size + 1, dtype=bool)
        last[(place + n)[take]] = True  # nothing comes after a text's last id
        line = np.full(size + 1, self.none, dtype=np.int32)
        line[at] = ids[own]
        self.y = line[:-1].reshape(-1, BLOCK)
        line = np.where(last[:-1], self.none, np.concatenate(([self.none], line[:-2])).astype(np.int32)) if size else line[:0]
        self.x = line.reshape(-1, BLOCK)
        self.cls = np.append(vocabulary.cls, CLASSES).astype(np.int32)

    def __len__(self) -> int:
        return len(self.x)

    def batch(self, at: np.ndarray, n: int):
        """(inputs, classes before, target ids, their classes, which are real) of runs of n + 1 blocks from ``at`` on."""
        place = at[:, None] + np.arange(n + 1)
        x, y = self.x[place], self.y[place[:, 1:]].ravel()
        return x, self.cls.take(x[:, 1:].ravel()), y, self.cls.take(y), y != self.none


def begun(model: Attention, rate: float) -> dict:
    return {"rng": np.random.default_rng(5), "square": np.zeros_like(model.flat), "mean": model.flat.copy(), "seen": 0, "rate": rate}


def train(model: Attention, inputs: Inputs, state: dict) -> None:
    """One pass of gradient steps over all windows, in runs in random order; ``state["mean"]`` averages the last steps' weights."""
    rng, square, mean = state["rng"], state["square"], state["mean"]
    whole = (len(inputs) - 1) // RUN
    starts = [(rng.permutation(whole) * RUN, RUN)]
    if rest := len(inputs) - 1 - whole * RUN:
        starts.append((np.array([whole * RUN]), rest))
    for order, n in starts:
        for at in np.array_split(order, max(1, len(order) * n // STEP)) if len(order) else []:
            x, c, _, y, real = inputs.batch(at, n)
            if not real.any():
                continue
            g, _ = model.gradient(x, c, np.where(real, y, -1), with_loss=False)
            square *= 0.98
            square += 0.02 * g * g
            state["seen"] += 1
            model.flat -= np.float32(state["rate"] / math.sqrt(1 + state["seen"] / 300)) * g / (np.sqrt(square / np.float32(1 - 0.98 ** state["seen"])) + np.float32(1e-6))
            mean += np.float32(max(AVERAGE, 2 / (state["seen"] + 1))) * (model.flat - mean)


def _train(size: int, vocabulary, weights, rate: float):
    """A partition's training on its rows: a row of new weights and the number of windows they were trained on."""

    def run(batches):
        _keep_freed_memory()
        v = vocabulary.value
        model, total = Attention(v.embedding, v.before, weights.value.copy()), 0
        state = begun(model, rate)
        for ids, begin, take in _encoded(batches, size):
            inputs = Inputs(v, ids, begin, take)
            if len(inputs):
                train(model, inputs, state)
                total += len(inputs)
        yield _row(w=state["mean"], n=total)

    return run


def _averaged(batches):
    """Weights averaged, each by the number of windows it was trained on: a row, or none if there are no windows."""
    total, n = 0.0, 0
    for r in _arrays(batches, w=np.float32, n=None):
        if r["n"]:
            total, n = total + r["w"].astype(np.float64) * r["n"], n + r["n"]
    if n:
        yield _row(w=(total / n).astype(np.float32), n=n)


def scores(model: Attention, v: Vocabulary, ids: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Natural log-probability of every id, from its window."""
    inputs = Inputs(v, ids, begin, np.ones(len(begin) - 1, dtype=bool))
    out = [np.zeros(0)]
    blocks = len(inputs) - 1
    whole = blocks // RUN * RUN
    runs = [(np.arange(a, min(a + STEP, whole), RUN), RUN) for a in range(0, whole, STEP)]
    if whole < blocks:
        runs.append((np.array([whole]), blocks - whole))
    for at, n in runs:
        x, c, y, cls, real = inputs.batch(at, n)
        p = model.score(x, c, np.where(real, cls, 0))
        out.append((p + v.within(c, y, cls))[real])
    return np.concatenate(out)


def _score(size: int, vocabulary, weights):
    """Log-probability of every passage, by row of ids: (bucket, phase, logp, ids of each text)."""

    def run(batches):
        _keep_freed_memory()
        v = vocabulary.value
        model = Attention(v.embedding, v.before, weights.value)
        for r in _arrays(batches, bucket=None, phase=None, ids=_small(size), begin=np.int64):
            ids = r["ids"].astype(np.int64)
            start = stops(ids, r["begin"])[0][:-1]
            yield _row(bucket=r["bucket"], phase=r["phase"], logp=np.add.reduceat(scores(model, v, ids, r["begin"]), start), size=np.diff(r["begin"]))

    return run


RESULT = [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("n_subwords", pa.int64())]


def remembered(logp: np.ndarray, others: np.ndarray, total: int) -> np.ndarray:
    """Log-probability of passages: mixture of the model's and of the share of others' equal passages among ``total``."""
    with np.errstate(divide="ignore"):
        return np.logaddexp(logp + math.log1p(-MEMORY), np.log(MEMORY * others / max(1, total)))


def _combine(n_tokens: int, n_distinct: int, n_ends: int, n_passages: int):
    """Results of the texts of a bucket from its counts (kind 0), the totals by part (1) and the passages' scores (2), in this order."""
    below = math.log10(n_tokens + SMOOTH * (n_distinct + 1))

    def out(own, totals, scored):
        held, n = np.frombuffer(own["a"], dtype=bool), np.frombuffer(own["d"], dtype=np.int64)
        word, passage, per_text = unplanes(own["e"]), unplanes(own["f"]), np.frombuffer(own["g"], dtype=np.int64)
        c = np.concatenate([np.frombuffer(x, dtype=np.int64) for x in totals])
        mine, text = c[word], np.repeat(np.arange(len(n)), n)
        base = np.bincount(text, weights=np.log10(mine + SMOOTH) - below, minlength=len(n)) + math.log10(n_ends + SMOOTH) - below
        known = np.bincount(text, weights=mine > 0, minlength=len(n)).astype(np.int64) + (n_ends > 0)
        logp = np.concatenate([np.frombuffer(x, dtype=np.float64) for x, _ in scored])
        size = np.concatenate([np.frombuffer(x, dtype=np.int64) for _, x in scored])
        text = np.repeat(np.arange(len(n)), per_text)
        which, distinct, _ = distinct_of(text.astype(np.uint64) * np.uint64(len(c)) + passage)
        others = c[passage] - np.where(held[text], 0, np.bincount(which, minlength=len(distinct))[which])
        score = np.bincount(text, weights=remembered(logp, others, n_passages), minlength=len(n)) / math.log(10)
        ids = pa.array(np.frombuffer(own["b"], dtype=np.int64), mask=~np.frombuffer(own["c"], dtype=bool))
        return pa.RecordBatch.from_arrays([pa.array(x, t) if not isinstance(x, pa.Array) else x for x, (_, t) in zip((ids, held, n + 1, known, np.full(len(n), n_tokens), base, score, size), RESULT, strict=True)], names=[k for k, _ in RESULT])

    def run(batches):
        own, totals, scored = None, [], []
        for batch in batches:
            for r in batch.to_pylist():
                if r["kind"] == 0:
                    if own:
                        yield out(own, totals, scored)
                    own, totals, scored = r, [], []
                elif r["kind"] == 1:
                    totals.append(r["a"])
                else:
                    scored.append((r["a"], r["b"]))
        if own:
            yield out(own, totals, scored)

    return run


def language_model_scores(spark: SparkSession, documents: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_subwords."""
    scratch = Scratch(spark, "lm")
    sc, tasks = spark.sparkContext, int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs.mapInArrow(_encode(ranks_path), ENCODED).write.option("compression", "zstd").partitionBy("phase").parquet(scratch.path("encoded"))
    encoded = spark.read.schema(ENCODED).parquet(scratch.path("encoded"))
    counts, ids = encoded.where("phase = -1"), encoded.where("phase >= 0").select("bucket", "phase", "ids", "begin", "held")
    sums = [F.coalesce(F.sum(c), F.lit(0)) for c in ("n_hash", "train_words", "train_passages", "train_texts")]
    n_hash, total, n_passages, ends = counts.agg(*sums).first()

    parts = max(tasks, -(-n_hash // PART))
    dealt = counts.select("bucket", "hash", "n").mapInArrow(_send(parts), "part long, bucket long, h binary, n binary").repartition(parts, "part").sortWithinPartitions("part")
    totals = scratch.save(dealt.mapInArrow(_total, "bucket long, part long, c binary, known long"), "totals")
    distinct = totals.where("bucket = -1").agg(F.coalesce(F.sum("known"), F.lit(0))).first()[0]

    def summed(rows: DataFrame, run, n: int) -> np.ndarray:
        found = rows.mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
        out = np.zeros(n, dtype=np.float32 if n > CLASSES * 1000 else np.float64)
        out[found.column("id").to_numpy()] = found.column("n").to_numpy()
        return out

    size = Subwords.load(ranks_path).size
    id_counts = summed(counts.select("ids", "begin"), _id_counts(size), size)
    cls = classes_of(id_counts)
    v = Vocabulary(id_counts, cls, *pair_tables(summed(ids.select("ids", "begin", "held"), _pair_counts(size, sc.broadcast(cls)), (CLASSES + 1) * (CLASSES + size) + CLASSES * size), cls))
    vocabulary, flat = sc.broadcast(v), Attention(v.embedding, v.before).flat
    for r in range(PHASES):
        now = sc.broadcast(flat)
        trained = ids.where(F.col("phase") == r).select("ids", "begin", "held").mapInArrow(_train(size, vocabulary, now, RATE / (1 + r)), "w binary, n long")
        # however many partitions trained, the driver gets AVERAGES rows
        rows = trained.repartition(AVERAGES).mapInArrow(_averaged, "w binary, n long").toArrow().to_batches()
        for x in _averaged(rows):
            flat = np.frombuffer(x.column("w")[0].as_py(), dtype=np.float32)
        now.unpersist()

    scored = ids.mapInArrow(_score(size, vocabulary, sc.broadcast(flat)), "bucket long, phase int, logp binary, size binary")
    blank = [F.lit(None).cast("binary").alias(c) for c in "abcdefg"]
    every = counts.select("bucket", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("o"), *[F.col(c).alias(a) for c, a in zip(("held", "doc_id", "known", "n_words", "word", "passage", "per_text"), "abcdefg", strict=True)])
    every = every.unionByName(totals.where("bucket >= 0").select("bucket", F.lit(1).alias("kind"), F.col("part").alias("o"), F.col("c").alias("a"), *blank[1:]))
    every = every.unionByName(scored.select("bucket", F.lit(2).alias("kind"), F.col("phase").cast("long").alias("o"), F.col("logp").alias("a"), F.col("size").alias("b"), *blank[2:]))
    dealt = every.repartition(tasks, "bucket").sortWithinPartitions("bucket", "kind", "o")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_subwords long"
    return dealt.mapInArrow(_combine(int(total + ends), int(distinct) + (ends > 0), int(ends), int(n_passages)), schema)
