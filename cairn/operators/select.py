"""Selecting and filtering entries of a tree.

entries: path, type (label), size, uid, mtime (epoch seconds). Hierarchy predicates are equi-joins on
exploded ancestors, never prefix joins: a prefix condition has no equi key and plans as a nested loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.paths import ancestors, is_hidden, normalized, parent
from ..functions.scalars import DAY, MIB, category


def normalize_includes(paths: DataFrame) -> DataFrame:
    """path: distinct, in the spelling that entries have; an invalid one raises when the plan runs."""
    return paths.select(normalized("path").alias("path")).distinct()


def select(entries: DataFrame, includes: DataFrame) -> DataFrame:
    """Entries that are included, lie below an included path, or above one. No includes: everything."""
    chosen = normalize_includes(includes)
    above = chosen.select(F.explode(ancestors("path")).alias("_p"), F.lit(False).alias("_c"))
    look = chosen.select(F.col("path").alias("_p"), F.lit(True).alias("_c")).unionByName(above).groupBy("_p").agg(F.bool_or("_c").alias("_c"))
    # A path is kept if it is included or above an include, or if one of its ancestors is included.
    probes = entries.select("path", F.explode(F.concat(ancestors("path"), F.array("path"))).alias("_p"))
    kept = probes.join(look, "_p").where(F.col("_c") | (F.col("_p") == F.col("path"))).select("path").distinct()
    return entries.join(kept, "path", "left_semi")


def missing(entries: DataFrame, includes: DataFrame) -> DataFrame:
    """Included paths that no entry has; a selection is complete if there is none."""
    return normalize_includes(includes).join(entries.select("path"), "path", "left_anti")


def matches_type(type_: Column, wanted: str) -> Column:
    if not wanted:
        return F.lit(True)
    return ~type_.isin("file", "directory", "symlink") if wanted == "special" else type_ == wanted


def matches_category(path: Column, type_: Column, wanted: str) -> Column:
    return F.lit(True) if not wanted else category(path, type_) == wanted


def matches_size(size: Column, type_: Column, band: int) -> Column:
    """Band 0: all; else files only: 1 empty, 2 under 1 MiB (empty ones too), 3 from 1 to under 100 MiB, 4 from 100 MiB."""
    if not band:
        return F.lit(True)
    bands = {1: size == 0, 2: size < MIB, 3: (size >= MIB) & (size < 100 * MIB), 4: size >= 100 * MIB}
    return (type_ == "file") & bands[band]


def matches_age(mtime: Column, choice: int, now: Column) -> Column:
    """0: all; 1, 2, 3, 5, 6: at most 1, 7, 30, 90, 365 days old, the limit included; 4: more than 30 days."""
    if not choice:
        return F.lit(True)
    if choice == 4:
        return mtime < now - 30 * DAY
    return mtime >= now - {1: 1, 2: 7, 3: 30, 5: 90, 6: 365}[choice] * DAY


def matches_search(path: Column, needle: str) -> Column:
    """Case-insensitive substring of the path, and so of the name; blanks around the needle do not count."""
    return F.lower(path).contains(needle.strip().lower()) if needle.strip() else F.lit(True)


def matching(entries: DataFrame, type_: str = "", category_: str = "", size_band: int = 0, age: int = 0, now: Column | None = None, hidden: bool = True, uid: int | None = None, search: str = "") -> DataFrame:
    """entries with `matches`: whether one passes all filters itself."""
    c = F.col
    test = matches_type(c("type"), type_) & matches_category(c("path"), c("type"), category_) & matches_size(c("size"), c("type"), size_band) & matches_search(c("path"), search)
    if age:
        test = test & matches_age(c("mtime"), age, now)
    if uid is not None:
        test = test & (c("uid") == uid)
    if not hidden:
        test = test & ~is_hidden("path")
    return entries.withColumn("matches", test)


def visible(marked: DataFrame, hidden: bool = True) -> DataFrame:
    """Rows of `matching` that match or have a match below, but nothing hidden or below a hidden directory unless `hidden`."""
    found = marked.where("matches")
    found = found if hidden else found.where(~is_hidden("path"))
    up = found.select(F.explode(ancestors("path")).alias("path")).distinct()
    return marked.join(found.select("path").unionByName(up).distinct(), "path", "left_semi")


def set_visible(leaves: DataFrame, shown: DataFrame, checked: bool) -> DataFrame:
    """leaves (path, type, checked) after all visible ones are checked or unchecked: checking leaves directories as they are, as one would bring in what its filter hides; unchecking takes all."""
    there = (checkable(shown) if checked else shown).select("path", F.lit(True).alias("_shown"))
    return leaves.join(there, "path", "left").withColumn("checked", F.when(F.col("_shown"), F.lit(checked)).otherwise(F.col("checked"))).drop("_shown")


def set_subtrees(entries: DataFrame, nodes: DataFrame, checked: bool) -> DataFrame:
    """entries (path, checked) after nodes (path) and all below them are set."""
    probes = entries.select("path", F.explode(F.concat(ancestors("path"), F.array("path"))).alias("_up"))
    hit = probes.join(nodes.select(F.col("path").alias("_up")).distinct(), "_up", "left_semi").select("path").distinct().withColumn("_hit", F.lit(True))
    return entries.join(hit, "path", "left").withColumn("checked", F.when(F.col("_hit"), F.lit(checked)).otherwise(F.col("checked"))).drop("_hit")


def columns_order(column: str, descending: bool = False) -> list[Column]:
    """Sort keys of a folder's listing: by name, type, category, size or mtime; numbers by value; ties by name."""
    keys = {"name": F.lower("name"), "type": F.col("type"), "category": category("name", "type"), "size": F.col("size"), "mtime": F.col("mtime")}
    first = keys[column]
    return [first.desc() if descending else first.asc(), F.col("name").asc()]


def checkable(shown: DataFrame) -> DataFrame:
    """What checking all visible entries checks: anything but directories."""
    return shown.where("type <> 'directory'")


def parent_states(leaves: DataFrame) -> DataFrame:
    """path, state of every directory above rows of path, checked: checked, unchecked, or partial where they differ below."""
    below = leaves.select(F.explode(ancestors("path")).alias("path"), F.col("checked").cast("int").alias("x")).groupBy("path").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    return below.select("path", F.when(F.col("lo") == 1, "checked").when(F.col("hi") == 0, "unchecked").otherwise("partial").alias("state"))


def minimal_cover(leaves: DataFrame) -> DataFrame:
    """path: the highest entries that are checked as a whole, directories or leaves; all of them together check what is checked."""
    full = parent_states(leaves).where("state = 'checked'").select("path").unionByName(leaves.where("checked").select("path"))
    lineage = full.select("path", F.explode_outer(ancestors("path")).alias("_up"))
    below = lineage.join(full.select(F.col("path").alias("_up")), "_up", "left_semi").select("path").distinct()
    return full.join(below, "path", "left_anti")


def whole_tree(leaves: DataFrame) -> DataFrame:
    """One row: whether everything is checked, which a selection spells as no includes."""
    return leaves.agg(F.coalesce(F.bool_and("checked"), F.lit(False)).alias("whole"))


def summary(leaves: DataFrame) -> DataFrame:
    """One row: entries, those selected, files selected and their bytes."""
    is_file = F.col("checked") & (F.col("type") == "file")
    return leaves.agg(F.count_if("checked").alias("selected"), F.count("*").alias("total"), F.count_if(is_file).alias("files"), F.coalesce(F.sum(F.when(is_file, F.col("size"))), F.lit(0)).cast("long").alias("bytes"))


def attach(entries: DataFrame) -> DataFrame:
    """entries with `attached`: whether the parent is an entry and a directory; top-level entries are."""
    up = entries.select(F.col("path").alias("_up"), (F.col("type") == "directory").alias("_dir"))
    joined = entries.withColumn("_up", parent("path")).join(up, "_up", "left")
    return joined.withColumn("attached", (F.col("_up") == "") | F.coalesce("_dir", F.lit(False))).drop("_up", "_dir")


def owners(entries: DataFrame) -> DataFrame:
    return entries.select("uid").distinct()


def nearest_existing(paths: DataFrame, directories: DataFrame) -> DataFrame:
    """path, found: for each path its deepest ancestor, or itself, among directories."""
    options = paths.select("path", F.posexplode(F.concat(ancestors("path"), F.array("path"))).alias("d", "found"))
    held = options.join(directories.select(F.col("path").alias("found")), "found")
    best = held.withColumn("r", F.row_number().over(W.partitionBy("path").orderBy(F.desc("d")))).where("r = 1").select("path", "found")
    return paths.select("path").distinct().join(best, "path", "left")
