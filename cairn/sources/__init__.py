"""Sources and sinks. `register(spark)` makes the formats `tree`, `archive` and `tree_changes` known to a session."""

from __future__ import annotations

from pyspark.sql import SparkSession


def register(spark: SparkSession) -> None:
    from .datasource import ArchiveSource, ChangeSource, TreeSource

    spark.dataSource.register(TreeSource)
    spark.dataSource.register(ArchiveSource)
    spark.dataSource.register(ChangeSource)
