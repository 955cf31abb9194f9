"""Snapshots, backup histories, accounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.scalars import is_snapshot_of, valid_backup_id

# Limits of a history listing and the bytes of a row besides its name.
MOST_ROWS, MOST_BYTES, ROW_BYTES = 4096, 1 << 20, 2 + 32 + 2 + 8 + 8 + 2 + 64


def retention(snapshots: DataFrame, keep: int, series: str = "series", name: str = "name") -> DataFrame:
    """snapshots with `kept`: the `keep` greatest names of each series."""
    return snapshots.withColumn("kept", F.row_number().over(W.partitionBy(series).orderBy(F.desc(name))) <= keep)


def own_snapshots(files: DataFrame, prefix: str, current: str = "") -> DataFrame:
    """Names of files (name, type) that are earlier snapshots of a source: regular ones of its name pattern, the current one left out."""
    return files.where((F.col("type") == "file") & is_snapshot_of("name", F.lit(prefix)) & (F.col("name") != current)).select("name")


def account_listing(files: DataFrame, records: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """An account's history: records (account, id, ...) of its `*.meta` files (account, name), newest first; ids are 32 hex digits, other files are not listed. An account with more than `most` raises."""
    ids = files.where(F.col("name").endswith(".meta")).select("account", F.regexp_extract("name", r"\A(.*)\.meta\z", 1).alias("id")).where(valid_backup_id("id")).distinct()
    n = F.count("*").over(W.partitionBy("account"))
    counted = records.join(ids, ["account", "id"], "left_semi").withColumn("_n", n)
    told = F.when(F.col("_n") <= most, F.col("id")).otherwise(F.raise_error(F.concat(F.lit("too many backups of "), F.col("account").cast("string"))))
    return counted.withColumn("id", told).drop("_n").orderBy("account", F.desc("timestamp"), "id")


def download(history: DataFrame, contents: DataFrame) -> DataFrame:
    """id, content of backups: contents (id, content) must have the size and sha256 that history (id, size, sha256) says, else it raises; a record without content is left out."""
    joined = history.select("id", "size", "sha256").join(contents.select("id", "content"), "id")
    good = (F.octet_length("content") == F.col("size")) & (F.sha2("content", 256) == F.col("sha256"))
    kind = contents.schema["content"].dataType
    return joined.select("id", F.when(good, F.col("content")).otherwise(F.raise_error(F.concat(F.lit("stored backup differs from its record: "), F.col("id").cast("string"))).cast(kind)).alias("content"))


def find_user(users: DataFrame, name: str) -> DataFrame:
    return users.where(F.col("name") == name)


def deletable(active: DataFrame, stored: DataFrame) -> DataFrame:
    """storage, user of accounts that may go: one open session, their own, and no stored files (storage, user)."""
    return sessions(active).where("deletable").select("storage", "user").join(stored, ["storage", "user"], "left_anti")


def latest(history: DataFrame, by: str = "name") -> DataFrame:
    """The newest row of each name, the least id among those of one time. An aggregate, not a window: rows meet once partially reduced."""
    others = [c for c in history.columns if c != by]
    best = history.groupBy(by).agg(F.max(F.struct("timestamp", F.struct((-F.col("id")).alias("o")), F.struct(*others).alias("row"))).alias("b"))
    return best.select(by, "b.row.*")


def listing_keys() -> list[Column]:
    """Sort keys of a history: newest first, then by id."""
    return [F.desc("timestamp"), F.col("id").asc()]


def listing(history: DataFrame) -> DataFrame:
    return history.orderBy(*listing_keys())


def search(history: DataFrame, needle: str) -> DataFrame:
    """Rows whose name or id contains the needle, case-insensitive, blanks around it dropped."""
    x = needle.strip().lower()
    return history.where(F.lower(F.col("name").cast("string")).contains(x) | F.lower(F.col("id").cast("string")).contains(x)) if x else history


def capacity(history: DataFrame, by: str = "account") -> DataFrame:
    """Rows and bytes of each account's listing, and whether it is within both limits."""
    out = history.groupBy(by).agg(F.count("*").alias("n_rows"), (F.lit(4) + F.sum(F.lit(ROW_BYTES) + F.octet_length(F.col("name").cast("string")))).cast("long").alias("n_bytes"))
    return out.withColumn("fits", (F.col("n_rows") <= MOST_ROWS) & (F.col("n_bytes") <= MOST_BYTES))


def within_capacity(history: DataFrame, by: str = "account") -> DataFrame:
    """history; an account beyond either limit of its listing raises."""
    over = capacity(history, by).where("NOT fits").select(by, F.lit(True).alias("_over"))
    told = F.when(F.col("_over"), F.raise_error(F.concat(F.lit("listing is too large: "), F.col(by).cast("string"))).cast("boolean"))
    return history.join(over, by, "left").where(told.isNull()).select(*history.columns)


def upsert(presets: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """presets with rows of new in place of those of the same keys."""
    return presets.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def downloadable(files: DataFrame) -> DataFrame:
    """id of backups that have both their content and their record. files: id, kind (bak, meta)."""
    return files.groupBy("id").agg(F.bool_or(F.col("kind") == "bak").alias("b"), F.bool_or(F.col("kind") == "meta").alias("m")).where("b AND m").select("id")


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    """Keys that more than one row has, and how many."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def sessions(active: DataFrame) -> DataFrame:
    """Open sessions of each (storage, user); an account with more than one cannot be deleted."""
    return active.groupBy("storage", "user").agg(F.count("*").alias("n")).withColumn("deletable", F.col("n") <= 1)


def snapshot_totals(runs: DataFrame) -> DataFrame:
    """One row: sums over the snapshots of an automatic run."""
    return runs.agg(F.count("*").alias("snapshots"), F.coalesce(F.sum("entry_count"), F.lit(0)).cast("long").alias("entry_count"), F.coalesce(F.sum("input_bytes"), F.lit(0)).cast("long").alias("input_bytes"))
