"""Tables written once and reread: intermediate results in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, one machine's session (as in tests) gets a temporary one; on a cluster no executor would see another's files there."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tesserql-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Paths that stage has written and unstage hasn't deleted.
_staged: list[str] = []


def stage(df: DataFrame, tag: str) -> DataFrame:
    """df, written to the shared folder and reread: its lineage ends there and any executor may be lost."""
    path = f"{shared_folder(df.sparkSession)}/tesserql/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    _staged.append(path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    if path in _staged:
        _staged.remove(path)


def unstage(*frames: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more."""
    for df in frames:
        _delete(df.sparkSession, df._staged_at)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Deletes, at the end, what is staged inside and still there, but for what is appended to the list that it gives. Results that read staged tables must have been written by then."""
    before, keep = set(_staged), []
    try:
        yield keep
    finally:
        for path in [p for p in _staged if p not in before and p not in {df._staged_at for df in keep}]:
            _delete(spark, path)


def numbered(df: DataFrame, name: str, order: list[str], start: int = 0) -> DataFrame:
    """df with dense numbers in an order. Each range of the order is numbered by itself, from the counts of the ranges before it, so no task numbers all rows."""
    ranged = df.repartitionByRange(partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    # Written once: ranges are drawn from a sample, and drawn anew they need not be the same.
    held = stage(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_nth", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "ranged")
    before, rows = start, []
    for part, count in sorted(tuple(r) for r in held.groupBy("_part").count().collect()):  # a row a partition
        rows.append((part, before))
        before += count
    offsets = df.sparkSession.createDataFrame(rows, "_part int, _before long")
    return held.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_nth")).drop("_part", "_nth", "_before")
