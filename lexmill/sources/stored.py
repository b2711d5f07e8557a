"""Tables that are written once and read again, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexmill.session import shared_dir, ship_code


class Stored:
    """Parquet tables under ``spark.checkpoint.dir``; they outlive executors and go when the process ends."""

    def __init__(self, spark: SparkSession, name: str):
        ship_code(spark)
        self.spark, self.base = spark, f"{shared_dir(spark).rstrip('/')}/lexmill-{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self.remove)

    def save(self, df: DataFrame, table: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.base}/{table}")
        return self.spark.read.schema(df.schema).parquet(f"{self.base}/{table}")

    def remove(self) -> None:
        try:
            sc = self.spark.sparkContext
            path = sc._jvm.org.apache.hadoop.fs.Path(self.base)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the JVM may be gone at exit; the folder belongs to the cluster, which clears it
            pass


_kept: dict[tuple, object] = {}


def once(spark: SparkSession, name: str, make: Callable[[Stored], object]):
    """What ``make`` stored under this name in the running application, made the first time that it is asked for."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _kept:
        for old in [k for k in _kept if k[0] != key[0]]:
            del _kept[old]
        _kept[key] = make(Stored(spark, name.rsplit("/", 1)[-1]))
    return _kept[key]
