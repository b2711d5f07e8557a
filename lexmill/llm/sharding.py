"""Sharding by a minimax contiguous partition, in DataFrame functions only.

Equal texts are one atomic group. Groups stand in the order of a hash of their text; the shards are contiguous runs of that
order. A binary search finds the smallest capacity for which filling shards greedily, one after the other, needs no more
shards than asked for; the cuts are where the greedy fill of that capacity ends each shard.

The order has as many entries as the corpus has texts, so the driver never sees it. It sees sums of slices of the order,
a fixed number at a time. With slices the greedy fill is known only within bounds; capacities are narrowed to those that the
bounds leave open, then only the slices in which a cut can still fall are read again, in finer steps, until every slice
that matters is one group. Each pass narrows by the number of slices.

Edge cases: a null text has size 1 and is a group with other nulls; an empty table gives no rows; with fewer groups than
shards some shards are empty; repeated rows share a shard and take a slot each; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.llm.scratch import Scratch

#: Slices for each cut that the driver reads at once.
SLICES = 2048
#: The order's keys are 60-bit.
KEY_END = 1 << 60
#: Rows that number themselves together within a shard.
CELL_ROWS = 20_000


def keyed(documents: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, key: equal texts, and only they, have equal keys."""
    text = F.col("text").cast("string")
    body = F.coalesce(text, F.lit(""))
    digest = F.md5(F.concat(F.when(text.isNull(), F.lit("n")).otherwise(F.lit("t")), body))
    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(F.encode(body, "UTF-8")).cast("long").alias("text_crc32"),
        F.conv(F.substring(digest, 1, 15), 16, 10).cast("long").alias("key"),
    )


class _Order:
    """What is known of the order: boundaries (key, bytes before it), and whether nothing lies between two of them."""

    def __init__(self, total: int):
        self.at, self.sum = [0, KEY_END], [0, total]
        self.whole: set[int] = set()  # sums before slices of a single group

    def refine(self, found: dict[int, tuple[int, bool]]) -> None:
        merged = dict(zip(self.at, self.sum, strict=True)) | {k: s for k, (s, _) in found.items()}
        self.at = sorted(merged)
        self.sum = [merged[k] for k in self.at]
        self.whole |= {s for s, one in found.values() if one}

    def reach(self, start: int, capacity: int) -> tuple[int, int]:
        """The last known boundary within capacity, and the most that an unknown one can add."""
        i = bisect_right(self.sum, start + capacity) - 1
        low = self.sum[i]
        return low, low if i + 1 == len(self.sum) or low in self.whole else start + capacity


def _fill(order: _Order, capacity: int, shards: int) -> tuple[list[int], list[int]]:
    """Lower and upper bounds of where each shard ends."""
    low, high = [0], [0]
    for _ in range(shards):
        low.append(order.reach(low[-1], capacity)[0])
        high.append(order.reach(high[-1], capacity)[1])
    return low[1:], high[1:]


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[list[int], int]:
    """(keys at which shards 1 on begin, capacity) for groups (key, size)."""
    total, largest = groups.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("size"), F.lit(0))).first()
    if not total:
        return [KEY_END] * (shards - 1), 0
    order = _Order(total)
    bottom = max(-(-total // shards), largest)
    least, most = bottom, bottom + largest  # greedy filling never leaves more than one group's room
    narrow = False
    while True:  # of two passes one at least cuts an open slice
        a, b = least, most  # smallest capacity that surely works
        while a < b:
            m = (a + b) // 2
            a, b = (a, m) if _fill(order, m, shards)[0][-1] >= total else (m + 1, b)
        most = a
        a, b = least, most  # smallest capacity that may work
        while a < b:
            m = (a + b) // 2
            a, b = (a, m) if _fill(order, m, shards)[1][-1] >= total else (m + 1, b)
        least = a
        lows, highs = _fill(order, least, shards)[0], _fill(order, most, shards)[1]
        spans = {}
        for lo, hi in zip(lows[:-1], highs[:-1], strict=True):
            i, j = bisect_right(order.sum, lo) - 1, bisect_right(order.sum, min(hi, total - 1))
            open_ = [x for x in range(i, j) if order.sum[x] not in order.whole and order.at[x + 1] - order.at[x] > 1 and order.sum[x] != order.sum[x + 1]]
            if open_ and narrow:  # one slice alone is sure to fall apart
                x = max(open_, key=lambda x: order.at[x + 1] - order.at[x])
                spans[order.at[x]] = order.at[x + 1]
            elif open_:
                spans[order.at[open_[0]]] = max(order.at[open_[-1] + 1], spans.get(order.at[open_[0]], 0))
        if least == most and _fill(order, most, shards)[0] == _fill(order, most, shards)[1] or not spans:
            break
        known = len(order.at)
        order.refine(_sums(groups, order, _disjoint(spans)))
        narrow = len(order.at) == known
    ends = _fill(order, most, shards)[0]
    return [order.at[bisect_right(order.sum, e) - 1] for e in ends[:-1]], most


def _disjoint(spans: dict[int, int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans.items()):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _sums(groups: DataFrame, order: _Order, spans: list[tuple[int, int]]) -> dict[int, tuple[int, bool]]:
    """Boundaries of finer slices of the spans: key -> (bytes before, slice is one group)."""
    found: dict[int, tuple[int, bool]] = {}
    known = dict(zip(order.at, order.sum, strict=True))
    cut = F.lit(None).cast("long")
    for i, (a, b) in enumerate(spans):
        width = max(1, -(-(b - a) // SLICES))
        cut = F.when(F.col("key").between(a, b - 1), F.expr(f"(key - {a}L) div {width}L + {i * (SLICES + 1)}")).otherwise(cut)
    rows = groups.where(" or ".join(f"(key >= {a} and key < {b})" for a, b in spans)).select(cut.alias("slice"), "key", "size")
    rows = rows.groupBy("slice").agg(F.sum("size").alias("s"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()
    by_span: dict[int, list] = {}
    for r in rows:
        by_span.setdefault(r["slice"] // (SLICES + 1), []).append(r)
    for i, own in by_span.items():
        at = known[spans[i][0]]
        for r in sorted(own, key=lambda r: r["lo"]):
            found[r["lo"]] = (at, r["lo"] == r["hi"])
            at += r["s"]
            found.setdefault(r["hi"] + 1, (at, False))  # keys crowd at times: the empty stretch after them is cut off
    return found


def shard(spark: SparkSession, documents: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, capacity."""
    scratch = Scratch(spark, "shards")
    rows = scratch.save(keyed(documents), "rows")
    groups = scratch.save(rows.groupBy("key").agg(F.sum("size").alias("size")), "groups")
    cuts, capacity = minimax_cuts(groups, shards)
    rows = rows.withColumn("shard", sum((F.col("key") >= F.lit(c)).cast("int") for c in cuts) if cuts else F.lit(0))
    cells = max(1, rows.count() // (shards * CELL_ROWS))
    rows = rows.withColumn("cell", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(cells)))
    sizes = rows.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("cell")) - F.col("n")
    at = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id", "key")) - 1
    rows = rows.withColumn("at", at).join(sizes.withColumn("before", before), ["shard", "cell"])
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("before") + F.col("at")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.lit(capacity).cast("long").alias("capacity"))
