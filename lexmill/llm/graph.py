"""Connected components of an edge table, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.scratch import Scratch


def components(edges: DataFrame, scratch: Scratch, limit: int = 60) -> DataFrame:
    """(node, root): for every node of ``edges`` (u, v long) the smallest node id that it can reach.

    Alternates large-star and small-star steps; each halves the distance to the root, so the number of rounds is
    logarithmic in the longest chain. Every round is written to the shared folder. An edge table without rows gives none. Beyond
    ``limit`` rounds it raises: a result that isn't final is never returned.
    """
    e = edges.where("u is not null and v is not null and u <> v")
    e = scratch.save(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges-0")
    for i in range(1, limit):
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(down.select("u", F.col("m").alias("v")))
        new = scratch.save(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"edges-{i}")
        x = new.groupBy("u").count().agg(F.count("*"), F.coalesce(F.max("count"), F.lit(0))).first()
        hanging = new.join(new.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count()
        scratch.drop(f"edges-{i - 1}")
        e = new
        if x[1] <= 1 and not hanging:
            break
    else:
        raise RuntimeError(f"no end after {limit - 1} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
