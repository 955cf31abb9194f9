"""The driver's tables as inputs of the operators, and the same as SQL. The bindings are this repository's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Entries: one file an order, below its customer and status; some names hidden, some no plain files.
ENTRIES_SQL = """entries AS (SELECT CASE WHEN o_custkey % 17 = 0 THEN '.' ELSE '' END || 'c' || o_custkey || '/' || o_orderstatus || '/' || o_orderkey ||
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN '.JPG' WHEN '2' THEN '.pdf' WHEN '3' THEN '.tar.gz' WHEN '4' THEN '' ELSE '.xyz' END AS path,
  CASE WHEN o_orderkey % 23 = 0 THEN 'symlink' WHEN o_orderkey % 29 = 0 THEN 'fifo' ELSE 'file' END AS type,
  CASE WHEN o_orderkey % 19 = 0 THEN 0 ELSE CAST(floor(o_totalprice) AS BIGINT) * CASE WHEN o_orderkey % 13 = 0 THEN 1000 ELSE 10 END END AS size,
  o_custkey AS uid, epoch_us(o_orderdate) // 1000000 AS mtime, 'c' || (o_custkey % 97) AS archive, o_orderkey AS id, o_orderstatus AS status FROM orders)"""
INCLUDES_SQL = """includes AS (SELECT DISTINCT path FROM (SELECT 'c' || o_custkey AS path FROM orders WHERE o_custkey % 50 = 1 UNION ALL
  SELECT 'c' || o_custkey || '/' || o_orderstatus AS path FROM orders WHERE o_custkey % 50 = 2 UNION ALL SELECT path FROM entries WHERE id % 40 = 3 UNION ALL SELECT 'lost/' || n_name AS path FROM nation))"""
UP_SQL = "SELECT {key}, array_to_string(string_split({path}, '/')[1:i], '/') AS up FROM (SELECT {key}, {path}, unnest(range(1, len(string_split({path}, '/')))) AS i FROM {table})"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: str) -> Column:
    return F.unix_seconds(F.col(ts).cast("timestamp"))


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    key, first = F.col("o_orderkey"), F.substring("o_orderpriority", 1, 1)
    ext = F.when(first == "1", ".JPG").when(first == "2", ".pdf").when(first == "3", ".tar.gz").when(first == "4", "").otherwise(".xyz")
    path = F.concat(F.when(F.col("o_custkey") % 17 == 0, ".").otherwise(""), F.lit("c"), F.col("o_custkey").cast("string"), F.lit("/"), F.col("o_orderstatus"), F.lit("/"), key.cast("string"), ext)
    size = F.when(key % 19 == 0, 0).otherwise(F.floor("o_totalprice").cast("long") * F.when(key % 13 == 0, 1000).otherwise(10))
    return o.select(
        path.alias("path"), F.when(key % 23 == 0, "symlink").when(key % 29 == 0, "fifo").otherwise("file").alias("type"), size.cast("long").alias("size"), F.col("o_custkey").alias("uid"), seconds("o_orderdate").alias("mtime"),
        F.concat(F.lit("c"), (F.col("o_custkey") % 97).cast("string")).alias("archive"), key.alias("id"), F.col("o_orderstatus").alias("status"),
    )


def includes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, e = table(spark, sf_dir, "orders"), entries(spark, sf_dir)
    whole = o.where("o_custkey % 50 = 1").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("path"))
    part = o.where("o_custkey % 50 = 2").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.lit("/"), F.col("o_orderstatus")).alias("path"))
    some = e.where("id % 40 = 3").select("path")
    lost = table(spark, sf_dir, "nation").select(F.concat(F.lit("lost/"), F.col("n_name")).alias("path"))
    return whole.unionByName(part).unionByName(some).unionByName(lost).distinct()


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as versions: a series has the same first 64 characters."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("content")).withColumn("series", F.substring("content", 1, 64))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("Backup "), F.col("o_custkey").cast("string")).alias("name"), seconds("o_orderdate").alias("timestamp"), F.floor("o_totalprice").cast("long").alias("size"), F.col("o_orderstatus").alias("account")
    )


HISTORY_SQL = "history AS (SELECT o_orderkey AS id, 'Backup ' || o_custkey AS name, epoch_us(o_orderdate) // 1000000 AS timestamp, CAST(floor(o_totalprice) AS BIGINT) AS size, o_orderstatus AS account FROM orders)"


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as paths; those of one part and supplier are one inode."""
    line = table(spark, sf_dir, "lineitem")
    path = F.concat(F.lpad(F.col("l_orderkey").cast("string"), 10, "0"), F.lit("/"), F.lpad(F.col("l_linenumber").cast("string"), 2, "0"), F.lit("/"), F.concat_ws("-", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), F.unix_micros(F.col("l_shipdate").cast("timestamp")).cast("string"), F.floor(F.col("l_extendedprice") * 100).cast("string")))
    return line.select(
        path.alias("path"), F.when(F.col("l_linenumber") == 7, "symlink").otherwise("file").alias("type"), F.col("l_partkey").alias("dev"), F.col("l_suppkey").alias("inode"), F.lit(0o644).alias("mode"), F.lit(0).cast("long").alias("uid"), F.lit(0).cast("long").alias("gid"),
        (F.col("l_partkey") * 10).alias("size"), seconds("l_shipdate").alias("atime"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).cast("long").alias("mtime"),
    )


LINKS_SQL = """links AS (SELECT lpad(CAST(l_orderkey AS VARCHAR), 10, '0') || '/' || lpad(CAST(l_linenumber AS VARCHAR), 2, '0') || '/' || l_partkey || '-' || l_suppkey || '-' || epoch_us(l_shipdate) || '-' || CAST(floor(l_extendedprice * 100) AS BIGINT) AS path, CASE WHEN l_linenumber = 7 THEN 'symlink' ELSE 'file' END AS type,
  l_partkey AS dev, l_suppkey AS inode, l_partkey * 10 AS size, epoch_us(l_shipdate) // 1000000 AS atime, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS mtime FROM lineitem)"""
