"""N-gram Jaccard join through a token-group matrix.

Documents are equal as sets of word shingles or not; each distinct set is a *class*. Classes are partitioned into groups of
similar sets (shared min-hash keys, propagated), cut into blocks of bounded size. For each group the matrix holds the union
of its members' prefix tokens. A query class meets a group only where its own prefix hits that union; the group is then
opened if the query's overlap with the group's whole token union can reach the threshold, and counted exactly against every
member. Prefixes follow one global token order, frequent tokens last, so two sets that reach the threshold always share a
prefix token: no link is lost. The order comes from a frequency sketch of fixed size; it only steers cost, never results.

Edge cases: null or empty texts have an empty set and no links; texts under ``k`` words are one shingle; equal texts link
by their class and are never expanded into pairs; shingles and sets are told apart by 64 bits, so that a wrong link needs a collision
(likely only beyond some 10^9 distinct sets); a null doc_id gets a null component; repeated doc_ids count as rows of
one document each with its own text; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.graph import components
from lexmill.llm.scratch import Scratch
from lexmill.llm.textvec import mix, shingle_sets, slices, tidy, words

#: Cells of the frequency sketch (bytes of one broadcast), tokens counted at once, least count that is noted.
SKETCH_BITS, SKETCH_TOKENS, SKETCH_LEAST = 22, 2_000_000, 3
#: Bits of the broadcast filter of classes that some group needs (a false positive costs a row, nothing else).
FILTER_BITS = 25
#: Shingles that a block of a group holds about; a block of members is held in memory at once.
BLOCK_TOKENS = 1_500_000
#: Prefix tokens of a part of the matrix about; a part is held in memory at once.
PART_TOKENS = 4_000_000
#: A min-hash key joins this many minima; there are six keys.
KEY_MINIMA = 4
_MULT = np.random.default_rng(7).integers(1, 2**63, 6 * KEY_MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Parity bits of a set, and those that sets of so many tokens have besides.
COARSE, FINE, FINE_FROM = 1024, 8192, 1200


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    for batch in batches:
        for a, texts in slices(batch.column("text")):
            yield batch.column("doc_id").slice(a, len(texts)), shingle_sets(words(texts), k)


def _cell(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _count_local(k: int):
    """Tokens that are frequent within a stretch of rows, as (cell, n)."""

    def run(batches):
        held, n = [], 0

        def flush():
            t, c = np.unique(np.concatenate(held), return_counts=True)
            t, c = t[c >= SKETCH_LEAST], c[c >= SKETCH_LEAST]
            return pa.RecordBatch.from_arrays([pa.array(_cell(t)), pa.array(c.astype(np.int64))], names=["cell", "n"])

        for _, sets in _sets(batches, k):
            held += sets
            n += sum(map(len, sets))
            if n >= SKETCH_TOKENS:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()

    return run


def _sketch(docs: DataFrame, k: int) -> np.ndarray:
    """log2 of the counts of frequent tokens by cell: 2**SKETCH_BITS bytes whatever the input."""
    counts = docs.mapInArrow(tidy(_count_local(k)), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    found = counts.select("cell", F.floor(F.log2(F.col("n"))).cast("byte").alias("level")).toArrow()
    out = np.zeros(1 << SKETCH_BITS, dtype=np.uint8)
    out[found.column("cell").to_numpy()] = np.minimum(found.column("level").to_numpy(), 63)
    return out


def fingerprint(s: np.ndarray) -> int:
    """64 bits of a whole set."""
    h = np.bitwise_xor.reduce(mix(s * _MULT[0])) + np.uint64(len(s))
    return int(mix(np.array([h ^ mix(s).sum(dtype=np.uint64)], dtype=np.uint64)).view(np.int64)[0])


def prefix_length(n: int, percent: int) -> int:
    """Tokens of a set of n of which any set that reaches the threshold holds one."""
    return n - -(-percent * n // 100) + 1


def _features(k: int):
    """Per document: class and set size, and for the first row of a class in a task its min-hash keys and parity bits."""

    def run(batches):
        seen = set()
        for ids, sets in _sets(batches, k):
            cls, size, keys, bits = [], [], [], []
            for s in sets:
                size.append(len(s))
                c = fingerprint(s) if len(s) else None
                cls.append(c)
                if c is None or c in seen:
                    keys.append(None), bits.append(None)
                    continue
                if len(seen) < 500_000:
                    seen.add(c)
                low = np.array([(s * m).min() for m in _MULT], dtype=np.uint64).reshape(-1, KEY_MINIMA)
                key = np.arange(len(low), dtype=np.uint64)
                for j in range(KEY_MINIMA):
                    key = mix(key + low[:, j])
                keys.append(key.view(np.int64)), bits.append(parity_bits(s))
            yield pa.RecordBatch.from_arrays(
                [ids.cast(pa.int64()), pa.array(cls, pa.int64()), pa.array(size, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(bits, pa.binary())],
                names=["doc_id", "c", "n", "keys", "bits"],
            )

    return run


def parity_bits(s: np.ndarray) -> bytes:
    """Bit i is the parity of the tokens that fall on i: two sets differ in at least as many tokens as in bits."""
    out = []
    for size in (COARSE, FINE) if len(s) >= FINE_FROM else (COARSE,):
        odd = np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
        out.append(np.packbits(odd.astype(np.uint8)).tobytes())
    return b"".join(out)


def _token_blocks(k: int, percent: int, sketch, parts: int):
    """Prefix tokens dealt to parts by hash, packed: a row for each part and stretch of documents."""

    def run(batches):
        order, seen, tokens, owners, n = sketch.value, set(), [], [], 0

        def flush():
            t, c = np.concatenate(tokens), np.concatenate(owners)
            h = mix(t)
            part = (h % np.uint64(parts)).astype(np.int64)
            by = np.argsort(part, kind="stable")
            t, c, part = (h[by] >> np.uint64(32)).astype(np.uint32), c[by], part[by]
            cut = np.flatnonzero(np.diff(part)) + 1
            ends = list(zip([0, *cut.tolist()], [*cut.tolist(), len(t)], strict=True))
            return pa.RecordBatch.from_arrays([pa.array(part[[a for a, _ in ends]]), pa.array([t[a:b].tobytes() for a, b in ends], pa.binary()), pa.array([c[a:b].tobytes() for a, b in ends], pa.binary())], names=["part", "t", "c"])

        for _, sets in _sets(batches, k):
            for s in sets:
                if not len(s) or (c := fingerprint(s)) in seen:
                    continue
                if len(seen) < 500_000:
                    seen.add(c)
                p = prefix_length(len(s), percent)
                ranked = (order[_cell(s)].astype(np.uint64) << np.uint64(58)) | (s >> np.uint64(6))
                tokens.append(np.partition(ranked, p - 1)[:p] if p < len(ranked) else ranked)
                owners.append(np.full(len(tokens[-1]), c, dtype=np.int64))
                n += len(tokens[-1])
            if n > 500_000:
                yield flush()
                tokens, owners, n = [], [], 0
        if n:
            yield flush()

    return run


def _shared_tokens(batches):
    """(token, c) of the tokens of a part that more than one class has. Rows come sorted by part; memory holds one part."""
    now, held = None, []

    def found():
        t = np.concatenate([np.frombuffer(x, dtype=np.uint32) for x, _ in held])
        c = np.concatenate([np.frombuffer(y, dtype=np.int64) for _, y in held])
        by = np.lexsort((c, t))
        t, c = t[by], c[by]
        new = np.concatenate(([True], (t[1:] != t[:-1]) | (c[1:] != c[:-1])))
        t, c = t[new], c[new]
        same = t[1:] == t[:-1]
        more = np.concatenate((same, [False])) | np.concatenate(([False], same))
        return pa.RecordBatch.from_arrays([pa.array((np.int64(now) << 32) + t[more].astype(np.int64)), pa.array(c[more])], names=["token", "c"])

    for batch in batches:
        for part, t, c in zip(batch.column("part").to_pylist(), batch.column("t").to_pylist(), batch.column("c").to_pylist(), strict=True):
            if part != now and held:
                yield found()
                held = []
            now = part
            held.append((t, c))
    if held:
        yield found()


class _Screen:
    """Which members and queries of a group can have a link at all, from parity bits alone."""

    def __init__(self, percent: int):
        self.percent, self.rows, self.ready = percent, [], False

    def close(self) -> None:
        self.ready, self.keep = True, np.zeros(len(self.rows), dtype=bool)
        self.n = np.array([n for _, n, _ in self.rows], dtype=np.int64)
        self.coarse = np.array([np.frombuffer(b[: COARSE // 8], dtype=np.uint64) for *_, b in self.rows], dtype=np.uint64).reshape(-1, COARSE // 64)
        self.is_fine = self.n >= FINE_FROM
        self.at = np.cumsum(self.is_fine) - 1
        fine = [np.frombuffer(b[COARSE // 8 :], dtype=np.uint64) for *_, b in self.rows if len(b) > COARSE // 8]
        self.fine = np.array(fine) if fine else np.zeros((0, FINE // 64), dtype=np.uint64)

    def may_link(self, n: int, bits: bytes, after: int = -1) -> np.ndarray:
        """Members that the bits don't rule out: |difference| <= (a + b)(1 - t) / (1 + t) where sets reach t."""
        i = np.flatnonzero((100 * np.minimum(self.n, n) >= self.percent * np.maximum(self.n, n)) & (np.arange(len(self.n)) > after))
        most = (100 - self.percent) * (self.n[i] + n) // (100 + self.percent)
        i = i[np.bitwise_count(self.coarse[i] ^ np.frombuffer(bits[: COARSE // 8], dtype=np.uint64)).sum(axis=1) <= most]
        if n >= FINE_FROM and len(i):
            fine = i[self.is_fine[i]]
            most = (100 - self.percent) * (self.n[fine] + n) // (100 + self.percent)
            out = np.bitwise_count(self.fine[self.at[fine]] ^ np.frombuffer(bits[COARSE // 8 :], dtype=np.uint64)).sum(axis=1) > most
            i = np.setdiff1d(i, fine[out], assume_unique=True)
        return i

    def finish(self) -> list[int]:
        for j, (_, n, b) in enumerate(self.rows if len(self.rows) > 1 else ()):
            i = self.may_link(n, b, j)
            if len(i):
                self.keep[i] = self.keep[j] = True
        return [self.rows[i][0] for i in np.flatnonzero(self.keep).tolist()]


def _screened(percent: int):
    """Rows sorted by group, members first; leaves those that can have a link."""

    def run(batches):
        names = ["c", "label", "block", "query"]
        screen, key, out = None, None, []

        def ended():
            if screen:
                if not screen.ready:
                    screen.close()
                out.extend((c, *key, 0) for c in screen.finish())

        def flush():
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            b = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], names=names)
            out.clear()
            return b

        for batch in batches:
            for label, block, query, c, n, bits in zip(*(batch.column(x).to_pylist() for x in ("label", "block", "query", "c", "n", "bits")), strict=True):
                if (label, block) != key:
                    ended()
                    screen, key = _Screen(percent), (label, block)
                if not query:
                    screen.rows.append((c, n, bits))
                    continue
                if not screen.ready:
                    screen.close()
                i = screen.may_link(n, bits)
                if len(i):
                    screen.keep[i] = True
                    out.append((c, *key, 1))
            yield flush()
        ended()
        yield flush()

    return run


def _bit(c: np.ndarray) -> np.ndarray:
    return (mix(c.view(np.uint64)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _needed_sets(k: int, wanted):
    """The sets of the classes that a group needs, one row a class and task."""

    def run(batches):
        bits, seen = wanted.value, set()
        for _, sets in _sets(batches, k):
            out_c, out_s = [], []
            for s in sets:
                if not len(s):
                    continue
                c = fingerprint(s)
                b = int(_bit(np.array([c]))[0])
                if bits[b >> 3] >> (b & 7) & 1 and c not in seen:
                    if len(seen) < 500_000:
                        seen.add(c)
                    out_c.append(c), out_s.append(s.tobytes())
            if out_c:
                yield pa.RecordBatch.from_arrays([pa.array(out_c, pa.int64()), pa.array(out_s, pa.binary())], names=["c", "s"])

    return run


class _Group:
    """An open group: members' tokens as an inverted list, exact counts for a query, a forest of links."""

    def __init__(self, percent: int):
        self.percent, self.c, self.w, self.sets, self.ready = percent, [], [], [], False

    def add(self, c: int, w: int, s: np.ndarray) -> None:
        self.c.append(c), self.w.append(w), self.sets.append(s)

    def close(self) -> None:
        self.ready = True
        m = len(self.c)
        self.size = np.array([len(s) for s in self.sets], dtype=np.int64)
        self.weight = np.array(self.w, dtype=np.int64)
        flat = np.concatenate(self.sets) if m else np.zeros(0, dtype=np.uint64)
        owner = np.repeat(np.arange(m), self.size)
        by = np.argsort(flat, kind="stable")
        self.token, at = np.unique(flat[by], return_index=True)  # the group's token union
        self.at, self.owner = np.append(at, len(flat)), owner[by]
        self.links, self.parent = np.zeros(m, dtype=np.int64), list(range(m))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def meet(self, s: np.ndarray, own: int = -1) -> np.ndarray:
        """Members that reach the threshold with s; only those after ``own`` if it is a member."""
        if not len(self.token):
            return np.zeros(0, dtype=np.int64)
        i = np.minimum(np.searchsorted(self.token, s), len(self.token) - 1)
        i = i[self.token[i] == s]
        if 100 * len(i) < self.percent * len(s):  # the bound: no member can reach it
            return np.zeros(0, dtype=np.int64)
        a, n = self.at[i], self.at[i + 1] - self.at[i]
        pick = np.repeat(a - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        both = np.bincount(self.owner[pick], minlength=len(self.c))
        hit = np.flatnonzero(100 * both >= self.percent * (self.size + len(s) - both))
        return hit[hit > own]

    def query(self, c: int, w: int, s: np.ndarray) -> list[tuple]:
        hit = self.meet(s)
        if not len(hit):
            return []
        self.links[hit] += w
        self._unite(hit)
        return [(c, self.c[int(hit[0])], int(self.weight[hit].sum()))]

    def _unite(self, hit: np.ndarray) -> None:
        r = self.root(int(hit[0]))
        for j in hit[1:].tolist():
            self.parent[self.root(j)] = r

    def finish(self) -> list[tuple]:
        for i, s in enumerate(self.sets if len(self.c) > 1 else ()):
            hit = self.meet(s, i)
            if len(hit):
                self.links[hit] += self.w[i]
                self.links[i] += int(self.weight[hit].sum())
                self._unite(np.append(hit, i))
        out = []
        for i in range(len(self.c)):
            r = self.root(i)
            if r != i or self.links[i]:
                out.append((self.c[i], self.c[r], int(self.links[i])))
        return out


def _open_groups(percent: int):
    """Rows sorted by group, members first: (c, other, links). Memory holds one block of members and one query."""

    def run(batches):
        schema = pa.schema([("c", pa.int64()), ("other", pa.int64()), ("links", pa.int64())])
        group, key, out = None, None, []

        def flush():
            cols = list(zip(*out, strict=True)) if out else [[], [], []]
            b = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], schema=schema)
            out.clear()
            return b

        for batch in batches:
            col = [batch.column(x).to_pylist() for x in ("label", "block", "query", "c", "w")]
            for *now, query, c, w, s in zip(*col, batch.column("s"), strict=True):
                s = np.frombuffer(s.as_buffer(), dtype=np.uint64)
                if now != key:
                    if group:
                        if not group.ready:
                            group.close()
                        out += group.finish()
                    group, key = _Group(percent), now
                if not query:
                    group.add(c, w, s.copy())
                else:
                    if not group.ready:
                        group.close()
                    out += group.query(c, w, s)
                if len(out) > 50_000:
                    yield flush()
        if group:
            if not group.ready:
                group.close()
            out += group.finish()
        yield flush()

    return run


def jaccard_join(spark: SparkSession, documents: DataFrame, percent: int = 80, k: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest linked doc_id), n_links (documents that this one links with itself)."""
    scratch = Scratch(spark, "jaccard")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sc = spark.sparkContext

    feats = scratch.save(docs.mapInArrow(tidy(_features(k)), "doc_id long, c long, n long, keys array<long>, bits binary"), "features")
    cls = feats.where("c is not null").groupBy("c").agg(F.min("doc_id").alias("low"), F.count("*").alias("w"), F.min("n").alias("n"), F.max("bits").alias("bits"))
    cls = scratch.save(cls, "classes")

    # groups of similar classes, in blocks of bounded size
    keys = scratch.save(_shared_keys(feats), "keys")
    labels = keys.select("c", F.col("c").alias("label")).distinct()
    for i in range(3):
        low = keys.join(labels, "c").groupBy("key").agg(F.min("label").alias("label"))
        labels = scratch.save(keys.join(low, "key").groupBy("c").agg(F.min("label").alias("label")), f"labels-{i}")
    members = cls.select("c", "w", "n").join(labels, "c", "left").select("c", "w", "n", F.coalesce("label", "c").alias("label"))
    blocks = members.groupBy("label").agg(F.count("*").alias("m"), F.ceil(F.sum("n") / BLOCK_TOKENS).alias("blocks"))
    members = members.join(blocks, "label").withColumn("block", F.expr("cast(pmod(xxhash64(c), blocks) as long)"))
    members = scratch.save(members, "members")

    # the matrix: (token, group) of prefix tokens that more than one group has
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    prefixes = cls.agg(F.coalesce(F.sum(F.col("n") - F.ceil(F.col("n") * percent / 100) + 1), F.lit(0)).cast("long")).first()[0]
    pieces = max(2 * parts, -(-prefixes // PART_TOKENS))
    order = sc.broadcast(_sketch(docs, k))
    dealt = docs.mapInArrow(tidy(_token_blocks(k, percent, order, pieces)), "part long, t binary, c binary").repartition(max(parts, pieces // 2), "part").sortWithinPartitions("part")
    hits = scratch.save(dealt.mapInArrow(tidy(_shared_tokens), "token long, c long"), "hits").join(members, "c")
    order.unpersist()
    matrix = hits.groupBy("token", "label", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    q = hits.select("token", "c", "n", F.col("label").alias("own"))
    far = q.join(matrix, "token").where(f"own < label and 100 * n >= {percent} * lo and 100 * hi >= {percent} * n").select("c", "label", "block").distinct()
    near = members.where("blocks > 1").select("c", "label", F.expr("explode(sequence(0, blocks - 1)) as block2"), "block").where("block2 > block").select("c", "label", F.col("block2").alias("block"))
    queries = scratch.save(far.union(near), "queries")

    asked = queries.select("label", "block").distinct().withColumn("asked", F.lit(True))
    opened = members.join(asked, ["label", "block"], "left").where("m > 1 or asked").select("c", "label", "block", F.lit(0).cast("long").alias("query"))
    roles = opened.union(queries.select("c", "label", "block", F.lit(1).cast("long").alias("query")))
    by_group = lambda df: df.repartition(parts, "label", "block").sortWithinPartitions("label", "block", "query")
    screened = by_group(roles.join(cls.select("c", "n", "bits"), "c")).mapInArrow(tidy(_screened(percent)), "c long, label long, block long, query long")
    roles = scratch.save(screened, "roles").join(cls.select("c", "w"), "c")

    wanted = sc.broadcast(_filter(roles.select("c").distinct()))
    sets = docs.mapInArrow(tidy(_needed_sets(k, wanted)), "c long, s binary").groupBy("c").agg(F.first("s").alias("s"))
    found = scratch.save(by_group(roles.join(sets, "c")).mapInArrow(tidy(_open_groups(percent)), "c long, other long, links long"), "links")
    wanted.unpersist()

    roots = components(found.select(F.col("c").alias("u"), F.col("other").alias("v")), scratch)
    per_class = cls.join(roots.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    lows = per_class.groupBy("root").agg(F.min("low").alias("component"))
    links = found.groupBy("c").agg(F.sum("links").alias("links"))
    per_class = per_class.join(lows, "root").join(links, "c", "left").select("c", "component", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"))
    return feats.select("doc_id", "c", "n").join(per_class, "c", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def _shared_keys(feats: DataFrame) -> DataFrame:
    """(c, key) of the min-hash keys that more than one class has."""
    rows = feats.where("keys is not null").select("c", F.explode("keys").alias("key")).distinct().repartition("key")
    many = rows.groupBy("key").agg(F.min("c").alias("a"), F.max("c").alias("b")).where("a <> b").select("key")
    return rows.join(many, "key", "left_semi")


def _set_bits(batches):
    for batch in batches:
        b = np.unique(_bit(batch.column("c").to_numpy()))
        yield pa.RecordBatch.from_arrays([pa.array(b >> 6), pa.array((np.uint64(1) << (b & 63).astype(np.uint64)).view(np.int64))], names=["word", "bits"])


def _filter(classes: DataFrame) -> np.ndarray:
    """A bitmap of fixed size over the classes."""
    found = classes.mapInArrow(tidy(_set_bits), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return out.view(np.uint8)
