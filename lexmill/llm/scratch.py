"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

from lexmill.session import shared_dir, ship_code


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each made longer until no column of ``df`` is called so, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        out.append(name)
        taken.add(name)
    return out


class Scratch:
    """Parquet (or ORC) tables under ``spark.checkpoint.dir``.

    A table cuts lineage and outlives any executor. ``drop`` removes one that nothing reads any more; what is left goes
    when the process ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        ship_code(spark)
        self.spark = spark
        self.base = f"{shared_dir(spark).rstrip('/')}/lexmill-{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self._remove, self.base)

    def path(self, table: str) -> str:
        return f"{self.base}/{table}"

    def save(self, df: DataFrame, table: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(table))
        return self.spark.read.schema(df.schema).parquet(self.path(table))

    def drop(self, table: str) -> None:
        self._remove(self.path(table))

    def _remove(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the JVM may be gone at exit; the folder belongs to the cluster, which clears it
            pass
