"""Catalogue operators: hard links, totals, offsets, orders, equality of trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window as W, functions as F

from ..functions.paths import depth
from .ranges import in_ranges, over_range, with_totals

_SAME = ("mode", "uid", "gid", "size", "mtime")


def fold_hardlinks(entries: DataFrame) -> DataFrame:
    """Files of one (dev, inode): the first path keeps its content, later ones become `hardlink` with link_target, size 0 and the first's atime.

    entries: path, type, dev, inode, mode, uid, gid, size, atime, mtime. `conflict` marks an alias
    whose metadata differ from the first's; an operation must not go on with one. One window, one
    shuffle by (dev, inode): a group is the paths of one inode.
    """
    keys = ["dev", "inode"]
    w = W.partitionBy(*keys, "type").orderBy("path")
    first = {c: F.first_value(c).over(w) for c in ("path", "atime", *_SAME)}
    alias = (F.col("type") == "file") & (F.row_number().over(w) > 1)
    differs = F.lit(False)
    for c in _SAME:
        differs = differs | ~F.col(c).eqNullSafe(first[c])
    out = entries.select("*", alias.alias("_alias"), (alias & differs).alias("conflict"), first["path"].alias("_path"), first["atime"].alias("_atime"))
    return out.select(
        "path", "dev", "inode", "mode", "uid", "gid", "mtime", "conflict", F.when(F.col("_alias"), "hardlink").otherwise(F.col("type")).alias("type"),
        F.when(F.col("_alias"), F.col("_path")).otherwise("").alias("link_target"), F.when(F.col("_alias"), 0).otherwise(F.col("size")).cast("long").alias("size"), F.when(F.col("_alias"), F.col("_atime")).otherwise(F.col("atime")).alias("atime"),
    )


def listed(folded: DataFrame) -> DataFrame:
    """Aliases shown as what they are to a reader: files of their target's size."""
    target = folded.where("type = 'file'").select(F.col("path").alias("link_target"), F.col("size").alias("_size"))
    out = folded.join(target, "link_target", "left")
    return out.withColumn("size", F.when(F.col("type") == "hardlink", F.col("_size")).otherwise(F.col("size"))).withColumn("type", F.when(F.col("type") == "hardlink", "file").otherwise(F.col("type"))).drop("_size")


def observed(entries: DataFrame, name: str = "progress") -> tuple[DataFrame, Observation]:
    """entries, and what has passed when an action on them is done: entry_count and input_bytes. A listener sees each streaming batch's."""
    seen = Observation(name)
    return entries.observe(seen, F.count("*").alias("entry_count"), F.coalesce(F.sum(F.when(F.col("type") == "file", F.col("size"))), F.lit(0)).alias("input_bytes")), seen


def totals(entries: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """entry_count and input_bytes (of regular files)."""
    return entries.groupBy(*by).agg(F.count("*").alias("entry_count"), F.coalesce(F.sum(F.when(F.col("type") == "file", F.col("size"))), F.lit(0)).cast("long").alias("input_bytes"))


def content_offsets(entries: DataFrame, by: str = "archive", start: int = 8) -> DataFrame:
    """entries with `offset`: where each one's content begins in its archive's content region, in path order; `start` bytes come first."""
    held = F.when(F.col("type") == "file", F.col("size")).otherwise(0)
    ranged = in_ranges(entries.withColumn("_held", held), by, ("path",), "offsets")
    joined = with_totals(ranged, by, {"_sum": F.sum("_held")}, lambda each, w: each.withColumn("_before", F.coalesce(F.sum("_sum").over(w), F.lit(0))))
    here = F.sum("_held").over(over_range(by, ("path",))) - F.col("_held")
    return joined.withColumn("offset", (F.lit(start) + F.col("_before") + here).cast("long")).select(*entries.columns, "offset")


def archive_keys(root: str = "") -> list[Column]:
    """Sort keys of an archive's entries: the root first, then by the path's bytes."""
    return [F.when(F.col("path") == root, 0).otherwise(1), F.col("path")]


def archive_order(entries: DataFrame, root: str = "") -> DataFrame:
    return entries.orderBy(*archive_keys(root))


def restore_order(entries: DataFrame) -> DataFrame:
    """Directories, outermost first; then everything else; then directories again, innermost first, for their metadata: path, step, rank."""
    d = depth("path")
    make = entries.where("type = 'directory'").select("path", F.lit(1).alias("step"), d.alias("rank"))
    nodes = entries.where("type <> 'directory'").select("path", F.lit(2).alias("step"), F.lit(0).alias("rank"))
    finish = entries.where("type = 'directory'").select("path", F.lit(3).alias("step"), (-d).alias("rank"))
    return make.unionByName(nodes).unionByName(finish)


def tree_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of either tree that the other lacks, with `side`; equal trees give none. Counts per row come from one aggregation, not two sorts."""
    names = left.columns
    both = left.withColumn("_n", F.lit(1)).unionByName(right.select(*names).withColumn("_n", F.lit(-1)))
    sums = both.groupBy(*names).agg(F.sum("_n").cast("long").alias("_n")).where("_n <> 0")
    return sums.select(*names, F.when(F.col("_n") > 0, "left").otherwise("right").alias("side"), F.abs("_n").alias("copies"))


def changed_since(before: DataFrame, now: DataFrame, keys: tuple[str, ...] = ("size", "dev", "inode", "mtime")) -> DataFrame:
    """path of entries that are not in the state they had before, null-safe on each key, or that are gone."""
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"b.{k}").eqNullSafe(F.col(f"n.{k}"))
    return before.alias("b").join(now.alias("n"), F.col("b.path") == F.col("n.path"), "left").where(F.col("n.path").isNull() | ~same).select("b.path")
