"""Checks before a restore: conflicts, types, space."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.paths import parent
from .ranges import in_ranges, over_range, with_totals
from .select import nearest_existing


def conflicts(entries: DataFrame, destination: DataFrame) -> DataFrame:
    """Entries that are not directories and whose path the destination has."""
    return entries.where("type <> 'directory'").join(destination.select("path"), "path", "left_semi")


def preflight(entries: DataFrame, destination: DataFrame, overwrite: bool = False) -> DataFrame:
    """path, problem of entries that cannot be restored: `type` where one side is a directory and the other is not, `conflict` where one is in the way."""
    there = destination.select("path", (F.col("type") == "directory").alias("_dir"), F.lit(True).alias("_there"))
    joined = entries.join(there, "path", "left").where("_there")
    problem = F.when((F.col("type") == "directory") != F.col("_dir"), "type").when((F.col("type") != "directory") & ~F.lit(overwrite), "conflict")
    return joined.select("path", problem.alias("problem")).where("problem IS NOT NULL")


def space_needed(steps: DataFrame, volume: str = "volume", order: tuple[str, ...] = ("ord",)) -> DataFrame:
    """volume, needed: the peak of what is occupied while entries are written one after the other and each frees `reclaimed` bytes after it, never below 0.

    The fold `occupied += size; peak = max; occupied -= min(occupied, reclaimed)` in closed form:
    with c the running sum of size - reclaimed, occupied after a step is c - min(0, least c so far).
    """
    ranged = in_ranges(steps.select(volume, *order, "size", (F.col("size") - F.col("reclaimed")).alias("_d")), volume, order, "steps")
    w = over_range(volume, order)
    lean = ranged.withColumn("_c", F.sum("_d").over(w))

    def before(each: DataFrame, earlier) -> DataFrame:
        """The sum of earlier ranges, and the least that any sum came to in them."""
        started = each.withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
        return started.withColumn("_least", F.min(F.col("_before") + F.col("_low")).over(earlier))

    joined = with_totals(lean, volume, {"_sum": F.sum("_d"), "_low": F.min("_c")}, before).withColumn("c", F.col("_before") + F.col("_c"))
    # Before a step: the sum without it, and the least sum so far, which nothing is at the start.
    past = F.col("c") - F.col("_d")
    least = F.least(F.lit(0), F.coalesce("_least", F.lit(0)), F.coalesce(F.min("c").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return joined.select(volume, (past - least + F.col("size")).alias("need")).groupBy(volume).agg(F.max("need").cast("long").alias("needed"))


def space_short(needed: DataFrame, volumes: DataFrame) -> DataFrame:
    """Volumes (volume, free) with less free than needed."""
    return needed.join(volumes, "volume").where("needed > free")


def refused(entries: DataFrame, destination: DataFrame, volumes: DataFrame, overwrite: bool = False) -> DataFrame:
    """problem, key of everything that stops a restore before it begins; none where it can go on.

    entries: path, type, size, ord, volume. destination: path, type, size, writable. volumes: volume,
    free. Types and conflicts of `preflight`, the nearest existing folder above an entry not being
    writable, and volumes with less room than the peak that entries in order need; what an entry
    replaces is free again after it.
    """
    types = preflight(entries.select("path", "type"), destination.select("path", "type"), overwrite).select("problem", F.col("path").alias("key"))
    up = nearest_existing(entries.select(parent("path").alias("path")).where("path <> ''"), destination.where("type = 'directory'").select("path"))
    locked = up.join(destination.where("type = 'directory' AND NOT writable").select(F.col("path").alias("found")), "found", "left_semi").select(F.lit("locked").alias("problem"), F.col("found").alias("key")).distinct()
    there = destination.where("type = 'file'").select("path", F.col("size").alias("_old"))
    steps = entries.join(there, "path", "left").select("volume", "ord", F.when(F.col("type") == "file", F.col("size")).otherwise(0).alias("size"), F.coalesce("_old", F.lit(0)).alias("reclaimed"))
    short = space_short(space_needed(steps), volumes).select(F.lit("space").alias("problem"), F.col("volume").cast("string").alias("key"))
    return types.unionByName(locked).unionByName(short)
