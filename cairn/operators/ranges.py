"""Ordered folds over groups that may hold most rows: rows are dealt by ranges of their order, folded in each range, and ranges are joined by their totals."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.window import WindowSpec

_STAGED: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir or the context's checkpoint folder; on one machine without either, a temporary one."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="cairn-")
        context.setCheckpointDir(found)
    return found.rstrip("/")


def staged(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read again: read often, computed once, whichever executors are lost."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cairn-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _STAGED.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete the staged tables of this session; results that still read them must be written first."""
    for owner, path in [x for x in _STAGED if x[0] is spark]:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        _STAGED.remove((owner, path))


def in_ranges(rows: DataFrame, by: str, order: tuple[str, ...], label: str) -> DataFrame:
    """rows with `_range`: a group's rows of one range stand together in its order, and ranges follow each other."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return staged(rows.repartitionByRange(n, by, *order).withColumn("_range", F.spark_partition_id()), label)


def over_range(by: str, order: tuple[str, ...]):
    """Rows of a group's range up to each one."""
    return W.partitionBy(by, "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)


def with_totals(ranged: DataFrame, by: str, totals: dict[str, Column], before: Callable[[DataFrame, WindowSpec], DataFrame]) -> DataFrame:
    """ranged joined with what its group's earlier ranges come to: before(totals of each range, window over earlier ranges) adds the columns. A group has as many totals as there are ranges, whatever it holds."""
    each = ranged.groupBy(by, "_range").agg(*(v.alias(k) for k, v in totals.items()))
    sums = before(each, W.partitionBy(by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)).drop(*totals)
    return ranged.join(sums.hint("merge"), [by, "_range"])
