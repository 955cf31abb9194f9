"""Token ids to binary files of range-coded blocks, and back.

The corpus is encoded once; the ids go to a staged table while each task counts them. The counts
make one shared frequency table (bounded by the vocabulary). The documents are then dealt by ranges
of doc_id; each range is one shard file: blocks of whole documents in ascending order. A file's rows are its blocks with
an index (shard, first id's place in the shard, the documents' ids and lengths), so that any block,
or part of one from a checkpoint, decodes by itself. A document beyond a block's size takes several
payloads of one row.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from . import rans
from .common import slices, staged, text_rows, utf8
from .wordpieces import id_kind, pieces, read_vocabulary, vocabulary_size

BLOCKS = "shard int, block int, first long, n long, doc_ids binary, lengths binary, payloads array<binary>"
_NAMES = [x.split()[0] for x in BLOCKS.split(", ")]
_TYPES = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.binary()))


def _squeezed(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def _spread(held: bytes) -> bytes:
    return pa.Codec("zstd").decompress(bytes(held[8:]), int.from_bytes(held[:8], "little"), asbytes=True)


def encoded(docs: DataFrame, vocabulary_path: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, ids (zstd over the narrowest type that holds the vocabulary's), n; and a task's counts of each id as rows with a null doc_id and n = -1."""
    vocabulary = read_vocabulary(vocabulary_path)
    shared, size = docs.sparkSession.sparkContext.broadcast(vocabulary), vocabulary_size(vocabulary, end_id)

    def encode(batches):
        table = pieces(shared)
        counts = np.zeros(size, np.int64)
        for batch in batches:
            for part in slices(batch, 1, 1 << 20):
                ids, n, _ = table.encode(*utf8(part.column(1)))
                ids = np.insert(ids.astype(id_kind(size), copy=False), np.cumsum(n), end_id)
                counts += np.bincount(ids, minlength=size)
                at = np.cumsum(np.concatenate([[0], n + 1]))
                packed = [_squeezed(ids[a:z].tobytes()) for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(packed, pa.binary()), pa.array(n + 1, pa.int64())], names=["doc_id", "ids", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([_squeezed(counts.tobytes())], pa.binary()), pa.array([-1], pa.int64())], names=["doc_id", "ids", "n"])

    return text_rows(docs, F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(encode, "doc_id long, ids binary, n long")


def frequency_table(rows: DataFrame, size: int) -> np.ndarray:
    """The counts of all tasks, added in two steps, as normalised frequencies; its size is the vocabulary's."""

    def add(frames):
        total = np.zeros(size, np.int64)
        for batch in frames:
            for x in batch.column(0):
                total += np.frombuffer(_spread(x.as_py()), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([_squeezed(total.tobytes())], pa.binary())], names=["ids"])

    counts = rows.where("n = -1").select("ids")
    total = np.zeros(size, np.int64)
    for row in counts.repartition(32).mapInArrow(add, "ids binary").toLocalIterator():
        total += np.frombuffer(_spread(row.ids), np.int64)
    return rans.normalised(total)


def write_token_files(docs: DataFrame, path: str, vocabulary_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", block: int = rans.BLOCK) -> None:
    """Write shard files and their frequency table below `path`.

    Documents go in ascending id order, nulls first; repeated ids follow each other. A null or
    empty text is its end id alone. An empty table makes files without blocks.
    """
    spark = docs.sparkSession
    rows = staged(encoded(docs, vocabulary_path, end_id, id_col, text_col), "ids")
    size = vocabulary_size(read_vocabulary(vocabulary_path), end_id)
    kind = np.dtype(id_kind(size)).newbyteorder("<")
    frequencies = frequency_table(rows, size)
    shared = spark.sparkContext.broadcast(frequencies)

    def write(batches):
        from pyspark import TaskContext

        table, shard, number, first = rans.Table(shared.value), TaskContext.get().partitionId(), 0, 0
        doc_ids, lengths, held = [], [], []

        def flush():
            nonlocal number, first
            ids = np.concatenate(held)
            numbers = np.array([x or 0 for x in doc_ids], "<i8").tobytes() + np.array([x is not None for x in doc_ids]).tobytes()
            payloads = [table.encode(ids[k : k + block]) for k in range(0, len(ids), block)]
            row = [[shard], [number], [first], [len(ids)], [numbers], [np.array(lengths, "<i8").tobytes()], [payloads]]
            number, first = number + 1, first + len(ids)
            for x in (doc_ids, lengths, held):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, _TYPES, strict=True)], names=_NAMES)

        for batch in batches:
            for doc_id, raw in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.frombuffer(_spread(raw.as_py()), kind)
                held.append(ids)
                doc_ids.append(doc_id.as_py())
                lengths.append(len(ids))
                if sum(lengths) >= block:
                    yield flush()
        if held:
            yield flush()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.where("n >= 0").repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids")
    ordered.select("doc_id", "ids").mapInArrow(write, BLOCKS).write.option("compression", "none").mode("overwrite").parquet(f"{path}/blocks")
    spark.createDataFrame([Row(frequencies=bytearray(frequencies.astype("<u4").tobytes()))], "frequencies binary").coalesce(1).write.mode("overwrite").parquet(f"{path}/table")


def _opened(spark: SparkSession, path: str):
    """The blocks below `path`, and broadcast: the frequency table, and how many ids stand before each shard."""
    shared = spark.sparkContext.broadcast(np.frombuffer(bytes(spark.read.parquet(f"{path}/table").first().frequencies), "<u4").astype(np.uint64))
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    # One number for each shard: as many as ranges of documents, whatever the corpus holds.
    before, starts = 0, {}
    for row in blocks.groupBy("shard").agg(F.sum("n").alias("n")).orderBy("shard").collect():
        starts[row.shard], before = before, before + row.n
    return blocks, shared, spark.sparkContext.broadcast(starts)


def read_token_files(spark: SparkSession, path: str, whole: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it, over all files), n_tokens, ids_crc32 and ids, from the files alone.

    `whole`: with the ids; else that column is null and nothing but digests leaves the tasks. ids_crc32 is that of the ids as little-endian unsigned 32-bit integers. Blocks decode in
    parallel, the stretches between a block's checkpoints side by side, each held against its checksums.
    """
    blocks, shared, places = _opened(spark, path)

    def decode(batches):
        table = rans.Table(shared.value)
        for batch in batches:
            for shard, first, doc_ids, lengths, payloads in zip(*(batch.column(k) for k in range(5)), strict=True):
                ids = np.concatenate([table.decode(x.as_py()) for x in payloads])
                n = len(lengths.as_py()) // 8
                each = np.frombuffer(lengths.as_py(), "<i8")
                known = np.frombuffer(doc_ids.as_py(), bool, n, 8 * n)
                at = np.concatenate([[0], np.cumsum(each)])
                for low in range(0, n, 512):
                    own = slice(low, low + 512)
                    mine = [np.ascontiguousarray(ids[a:b], "<u4").tobytes() for a, b in zip(at[:-1][own], at[1:][own], strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(doc_ids.as_py(), "<i8", n)[own], mask=~known[own]), pa.array(places.value[shard.as_py()] + first.as_py() + at[:-1][own]), pa.array(each[own]), pa.array([zlib.crc32(x) for x in mine], pa.int64()), pa.array(mine if whole else [None] * len(mine), pa.binary())], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    return blocks.select("shard", "first", "doc_ids", "lengths", "payloads").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def read_token_range(spark: SparkSession, path: str, begin: int, end: int) -> DataFrame:
    """position, ids (little-endian unsigned 32-bit): the ids from place `begin` to before `end` of all files, in pieces in any order.

    Only blocks of the range are read, and of those only what lies between the checkpoints around it
    is decoded.
    """
    blocks, shared, places = _opened(spark, path)
    shard_starts = F.create_map(*(F.lit(x) for pair in places.value.items() for x in pair)) if places.value else F.create_map().cast("map<int,bigint>")
    placed = blocks.select((F.element_at(shard_starts, F.col("shard")) + F.col("first")).alias("at"), "n", "payloads").where((F.col("at") < end) & (F.col("at") + F.col("n") > begin))

    def decode(batches):
        table = rans.Table(shared.value)
        for batch in batches:
            for at, payloads in zip(batch.column(0), batch.column(1), strict=True):
                low = at.as_py()
                for payload in payloads.as_py():
                    n, step = rans.sizes(payload)
                    if low < end and low + n > begin and n:
                        first, last = max(0, begin - low) // step, -(-min(n, end - low) // step)
                        ids, low_here = table.decode(payload, first, last), low + first * step
                        a, z = max(begin - low_here, 0), min(end - low_here, len(ids))
                        yield pa.RecordBatch.from_arrays([pa.array([low_here + a]), pa.array([np.ascontiguousarray(ids[a:z], "<u4").tobytes()], pa.binary())], names=["position", "ids"])
                    low += n

    return placed.select("at", "payloads").mapInArrow(decode, "position long, ids binary")
