"""A stream of file events that keeps a snapshot of changed paths."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "ts timestamp, path string, event_type string"


def file_events(spark: SparkSession, path: str, extensions: list[str], max_files: int | None = None) -> DataFrame:
    """Events (JSON lines) of paths with one of the extensions."""
    reader = spark.readStream.schema(EVENTS)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    rx = "(?i)\\.(" + "|".join(e.lstrip(".") for e in extensions) + ")$"
    return reader.json(path).where(F.regexp_like("path", F.lit(rx)))


def latest(events: DataFrame) -> DataFrame:
    """The last event of each path in a batch."""
    w = Window.partitionBy("path").orderBy(F.desc("ts"), F.desc("event_type"))
    return events.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def watch(events: DataFrame, apply, checkpoint: str) -> StreamingQuery:
    """Calls ``apply(changed paths, batch id)`` for each micro-batch that is there, then ends. Replays give the same batches."""
    return events.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, i: apply(latest(df), i)).start()


# events with content checksums: state by path, moves, idempotent outcomes

SUMS = EVENTS + ", checksum string"
CHANGES = "path string, kind string, checksum string, ts timestamp"
STATE = "checksum string, ts timestamp, alive boolean"


def path_changes(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Changes (path, kind, checksum, ts) of a stream of events (ts, path, event_type, checksum): created, modified or deleted.

    The state of a path is its last checksum and time. An event that is no later than its path's last one, repeated or out of order, changes
    nothing, nor does one that leaves the checksum as it is. A delete has the checksum that the path had, null for a path never
    seen. A deleted path is forgotten when the watermark has passed it.
    """

    def advance(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        last, seen, alive = state.get if state.exists else (None, None, None)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_type", "checksum"], na_position="first")
        out = []
        for r in rows.itertuples(index=False):
            if seen is not None and r.ts <= pd.Timestamp(seen):
                continue
            seen = r.ts
            if r.event_type == "deleted":
                if alive is not False:
                    out.append((key[0], "deleted", last, r.ts))
                alive = False
            elif r.checksum != last or not alive:
                out.append((key[0], "modified" if alive else "created", r.checksum, r.ts))
                last, alive = r.checksum, True
        state.update((last, pd.Timestamp(seen).to_pydatetime(), alive))
        if alive is False:
            state.setTimeoutTimestamp(max(int(pd.Timestamp(seen).timestamp() * 1000), state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame(out, columns=["path", "kind", "checksum", "ts"])

    return events.withWatermark("ts", late).groupBy("path").applyInPandasWithState(advance, CHANGES, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def paired(changes: DataFrame, pending: DataFrame, wait_seconds: int) -> tuple[DataFrame, DataFrame]:
    """(outcomes (path, kind, dest, checksum, ts), deletes that still wait): a delete and a create of one checksum are one move.

    The n-th delete of a checksum, those that wait included, goes with its n-th create, by time and path. A delete waits for
    ``wait_seconds`` of event time; a null checksum has no partner.
    """
    nth = lambda df: df.withColumn("nth", F.row_number().over(Window.partitionBy("checksum").orderBy("ts", "path")))
    gone = nth(pending.unionByName(changes.where("kind = 'deleted'")))
    come = nth(changes.where("kind = 'created'"))
    both = gone.alias("g").join(come.alias("c"), (F.col("g.checksum") == F.col("c.checksum")) & (F.col("g.nth") == F.col("c.nth")), "full_outer")
    both = both.select(F.coalesce("g.path", "c.path").alias("path"), F.when(F.col("g.path").isNull(), "created").when(F.col("c.path").isNull(), "deleted").otherwise("moved").alias("kind"), F.when(F.col("g.path").isNotNull(), F.col("c.path")).alias("dest"), F.coalesce("g.checksum", "c.checksum").alias("checksum"), F.coalesce("c.ts", "g.ts").alias("ts"))
    rest = changes.where("kind = 'modified'").select("path", "kind", F.lit(None).cast("string").alias("dest"), "checksum", "ts")
    now = changes.unionByName(pending).agg(F.max("ts").alias("now"))  # one row
    every = both.unionByName(rest).crossJoin(now)
    waits = (F.col("kind") == "deleted") & (F.col("ts") + F.make_dt_interval(secs=F.lit(float(wait_seconds))) > F.col("now"))
    return every.where(~waits).drop("now"), every.where(waits).select("path", "kind", "checksum", "ts")


def watch_moves(changes: DataFrame, apply, folder: str, wait_seconds: int = 60) -> StreamingQuery:
    """Calls ``apply(outcomes, batch id)`` for each micro-batch of ``path_changes`` that is there, then ends.

    Outcomes and waiting deletes are stored under the batch's id before they are applied, from the deletes that waited before it, so
    a batch that is run again after a failure gives and stores the same. ``folder`` holds the checkpoint too and is shared.
    """
    spark = changes.sparkSession

    def one(batch: DataFrame, number: int) -> None:
        before = _waiting(spark, folder, number)
        out, waits = paired(batch.persist(), before, wait_seconds)
        out.write.mode("overwrite").parquet(f"{folder}/outcomes/{number:012d}")
        waits.write.mode("overwrite").parquet(f"{folder}/waiting/{number:012d}")
        batch.unpersist()
        apply(spark.read.parquet(f"{folder}/outcomes/{number:012d}"), number)

    return changes.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(one).start()


def _waiting(spark: SparkSession, folder: str, before: int) -> DataFrame:
    """The deletes that the last batch before a number left waiting."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/waiting")
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []
    done = [n for n in done if n < f"{before:012d}" and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/waiting/{n}/_SUCCESS"))]
    return spark.read.schema(CHANGES).parquet(f"{folder}/waiting/{max(done)}") if done else spark.createDataFrame([], CHANGES)


def still_waiting(spark: SparkSession, folder: str) -> DataFrame:
    """Deletes that no create has met so far: what a stream that has ended for good still has to apply."""
    return _waiting(spark, folder, 10**12 - 1)
