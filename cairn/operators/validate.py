"""Constraint queries: violations as rows (rule, key); a valid input has none."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.paths import ancestors, is_inside, is_safe
from .ranges import staged

MOST_ENTRIES = 1_000_000


class Invalid(ValueError):
    """Raised by assert_valid."""


def _rules(rows: DataFrame, key: Column, tests: dict[str, Column]) -> DataFrame:
    """One pass: a row for each rule that a row breaks."""
    found = F.filter(F.array(*(F.when(test, F.lit(name)) for name, test in tests.items())), lambda x: x.isNotNull())
    return rows.select(F.explode(found).alias("rule"), key.cast("string").alias("key"))


def row_violations(entries: DataFrame) -> DataFrame:
    """Rules of a row alone. entries: path, type_id, mode, size, mtime_ns, link_target, device."""
    c = F.col
    return _rules(
        entries,
        c("path"),
        {
            "type": ~c("type_id").between(1, 8),
            "nanoseconds": (c("mtime_ns") < 0) | (c("mtime_ns") >= 1_000_000_000),
            "mode": c("mode").bitwiseAND(0o7777) != c("mode"),
            "size": (c("type_id") != 1) & (c("size") != 0),
            "link_target": ~c("type_id").isin(3, 8) & (c("link_target") != ""),
            "device": ~c("type_id").isin(5, 6) & (c("device") != 0),
        },
    )


def entry_violations(entries: DataFrame, root: str, most: int | None = MOST_ENTRIES) -> DataFrame:
    """Rules across entries (ord, path, type_id, link_target, and mode, uid, gid, mtime for aliases): unsafe or repeated paths, outside the root, root not first, ancestors that are missing or no directories, aliases without an earlier file of the same metadata, too many or none. `most` is what one archive may hold; None for trees that are not one archive, of any size. Entries are staged, as each rule reads them."""
    c = F.col
    meta = ["mode", "uid", "gid", "mtime"]
    entries = staged(entries.select("ord", "path", "type_id", "link_target", *meta), "entries")
    alone = _rules(entries, c("path"), {"unsafe": ~is_safe("path"), "outside": ~is_inside("path", F.lit(root))})
    repeated = entries.groupBy("path").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate").alias("rule"), c("path").alias("key"))
    first = entries.agg(F.min_by(F.struct("path", "type_id"), "ord").alias("f"), F.count("*").alias("n"))
    whole = first.select(F.explode(F.filter(F.array(F.when(c("n") == 0, "empty"), F.when(F.lit(False) if most is None else c("n") > most, "too_many"), F.when((c("n") > 0) & ((c("f.path") != root) | (c("f.type_id") != 2)), "root")), lambda x: x.isNotNull())).alias("rule"), F.lit(root).alias("key"))
    kinds = entries.groupBy(c("path").alias("_up")).agg(F.bool_or(c("type_id") == 2).alias("_dir"))
    # Each distinct ancestor is looked up once, whatever number of entries lie below it.
    up = entries.select("path", F.explode(ancestors("path")).alias("_up"))
    bad = up.select("_up").distinct().join(kinds, "_up", "left").where("_dir IS NULL OR NOT _dir").select("_up", F.when(c("_dir").isNull(), "parent_missing").otherwise("parent_type").alias("rule"))
    lineage = up.join(bad, "_up").select("rule", c("path").alias("key"))
    files = entries.where("type_id = 1").select(c("path").alias("link_target"), c("ord").alias("_ord"), *(c(m).alias(f"_{m}") for m in meta))
    same = reduce(lambda a, b: a & b, (c(m).eqNullSafe(c(f"_{m}")) for m in meta))
    aliases = entries.where("type_id = 8").join(files, "link_target", "left")
    links = aliases.select(F.when(c("_ord").isNull(), "alias_target").when(c("_ord") >= c("ord"), "alias_order").when(~same, "alias_metadata").alias("rule"), c("path").alias("key")).where("rule IS NOT NULL")
    return reduce(DataFrame.unionByName, [alone, repeated, whole, lineage, links])


def content_violations(entries: DataFrame, archives: DataFrame, start: int = 8) -> DataFrame:
    """Content outside its archive's content region: entries (archive, path, type_id, size, offset), archives (archive, content_end)."""
    joined = entries.join(archives.select("archive", "content_end"), "archive")
    file = F.col("type_id") == 1
    inside = (F.col("offset") >= start) & (F.col("offset") <= F.col("content_end")) & (F.col("size") <= F.col("content_end") - F.col("offset"))
    return _rules(joined, F.concat_ws(":", F.col("archive").cast("string"), "path"), {"content": file & ~inside, "offset": ~file & (F.col("offset") != 0)})


def header_violations(headers: DataFrame) -> DataFrame:
    """Rules of an archive header (archive, magic, version, header_size, flags, pack, compression, encryption, reserved)."""
    c = F.col
    known = c("pack").isin(1, 2) & c("compression").between(0, 3) & c("encryption").isin(0, 3, 4)
    flags = F.lit(1) + F.when(c("compression") != 0, 2).otherwise(0) + F.when(c("encryption") != 0, 4).otherwise(0)
    return _rules(
        headers,
        c("archive"),
        {
            "magic": c("magic") != "BKP2", "version": ~c("version").between(1, 4), "header_size": c("header_size") != 112, "reserved": c("reserved") != 0,
            "algorithm": ~known, "lz77_version": (c("compression") == 3) & (c("version") < 3), "v4_encrypted": (c("version") == 4) & (c("encryption") == 0), "flags": known & (c("flags") != flags),
        },
    )


def hardlink_versions(headers: DataFrame, entries: DataFrame) -> DataFrame:
    """Archives of version 1 that have hard links. entries: archive, type_id."""
    return headers.where("version = 1").join(entries.where("type_id = 8"), "archive", "left_semi").select(F.lit("v1_hardlink").alias("rule"), F.col("archive").cast("string").alias("key"))


def upload_violations(uploads: DataFrame, contents: DataFrame) -> DataFrame:
    """Uploads (id, name, declared_size, declared_sha256) that do not match their content (id, content)."""
    got = contents.select("id", F.octet_length("content").alias("_n"), F.sha2("content", 256).alias("_sha"))
    c = F.col
    return _rules(uploads.join(got, "id", "left"), c("id"), {"missing": c("_n").isNull(), "size": c("_n") != c("declared_size"), "digest": c("_sha") != c("declared_sha256"), "name": F.octet_length("name") > 256})


def check_automatic(keep: int, interval_ms: int, source: str, output: str) -> None:
    """Options of an automatic run: 1 to 10000 kept, 20 ms to 7 days, output outside the source."""
    if not 1 <= keep <= 10_000 or not 20 <= interval_ms <= 7 * 86_400_000:
        raise Invalid("keep or interval out of range")
    if output == source or output.startswith(source.rstrip("/") + "/"):
        raise Invalid("output lies inside the source")


def position(entries: DataFrame) -> DataFrame:
    """entries with `ord` by path: for entries that come without an order of their own."""
    return entries.withColumn("ord", F.row_number().over(W.partitionBy(F.substring_index("path", "/", 1)).orderBy("path")))


def assert_valid(violations: DataFrame) -> None:
    """Raise if there is any violation; names a few."""
    if found := violations.take(5):
        raise Invalid("; ".join(f"{r.rule}: {r.key}" for r in found))
