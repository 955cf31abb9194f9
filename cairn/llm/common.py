"""What the operators share: staged tables, Arrow text as numpy bytes, words and their hashes."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Words are runs of anything but these bytes.
SPACES = b" \t\n\v\f\r"
#: The same as a class of Java's and Python's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"
SPACE_RUN = r"[\x20\x09-\x0D]+"

#: Rows of an Arrow batch at most: batches carry whole texts, and JVM and Python hold some of them each.
BATCH_ROWS = 1000
_BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"

_STAGED: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir or the context's checkpoint folder; on one machine without either, a temporary one."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="cairn-")
        context.setCheckpointDir(found)
    return found.rstrip("/")


def text_rows(docs: DataFrame, *columns) -> DataFrame:
    """These columns of docs, for a task in Python; lowers the session's Arrow batches to BATCH_ROWS rows."""
    conf = docs.sparkSession.conf
    if not 0 < int(conf.get(_BATCH_KEY, "10000")) <= BATCH_ROWS:
        conf.set(_BATCH_KEY, str(BATCH_ROWS))
    return docs.select(*columns)


def fenced(df: DataFrame) -> DataFrame:
    """df behind a projection that filters stay above.

    Pushed below projections, a filter takes their expressions along; where a lambda names a computed
    array, it would compute that array again for each element. A field that is not a function of the
    row keeps the projection whole.
    """
    held = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns), F.monotonically_increasing_id().alias("_n")).alias("_fence"))
    return held.select(*(F.col("_fence").getField(c).alias(c) for c in df.columns))


def staged(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read again: what follows never recomputes it, whichever executors are lost."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cairn-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _STAGED.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._cairn_path = path
    return out


#: The column that `numbered` adds.
ROW = "_cairn_row"


def numbered(docs: DataFrame, label: str = "rows") -> DataFrame:
    """docs with a number of each row's own, staged so that it stays: what is found of a row goes back to it, whatever ids are null or repeated."""
    return staged(docs.withColumn(ROW, F.monotonically_increasing_id()), label)


def kept_until_release(spark: SparkSession, path: str) -> str:
    """path, which `release` deletes with the staged tables."""
    _STAGED.append((spark, path))
    return path


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(table: DataFrame) -> None:
    """Delete a staged table that nothing yet to be computed reads."""
    spark, path = table.sparkSession, table._cairn_path
    _delete(spark, path)
    _STAGED[:] = [x for x in _STAGED if x[1] != path]


def release(spark: SparkSession) -> None:
    """Delete the staged tables of this session; results that still read them must be written first."""
    for owner, path in [x for x in _STAGED if x[0] is spark]:
        _delete(spark, path)
        _STAGED.remove((owner, path))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string or binary column as one byte array and len + 1 offsets into it; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(batch: pa.RecordBatch, text: int, most: int = 2 << 20):
    """The batch in slices of about `most` bytes of the column `text`, a row at least: bounds the memory of what follows."""
    _, at = utf8(batch.column(text))
    low = 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(at, at[low] + most, "right")) - 1)
        yield batch.slice(low, high - low)
        low = high


_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
#: The lowest 0 to 8 bytes of a number.
_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Words beyond so many bytes are hashed by the library in one call.
LONG_WORD = 512


def eights(raw: np.ndarray) -> np.ndarray:
    """Eight bytes from each place of raw, and from its end, as one number, the first byte lowest; zeros after the end."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    return np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))


def block(eight: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The first eight bytes, or fewer, of strings of these sizes."""
    return eight[at] & _BYTES[np.minimum(size, 8)]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and how many words each text has."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at) - 1, np.int64)
    inside = np.zeros(len(raw) + 1, bool)
    np.logical_not(_SPACE[raw], out=inside[:-1])
    first = inside[:-1].copy()
    first[1:] &= ~inside[:-2]
    edge = at[:-1][at[:-1] < len(raw)]
    first[edge] = inside[edge]
    last = inside[:-1] & ~inside[1:]
    edge = at[1:][at[1:] > 0] - 1
    last[edge] = inside[edge]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.diff(np.searchsorted(starts, at))


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word; A-Z as a-z where `lower`.

    Blocks of eight bytes go one after another through a bijection, so words of one length that
    differ in one block never collide, and no sum over positions can cancel.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    low = _LOWER[raw] if lower else raw
    eight, size = eights(low), ends - starts
    h = mixed(block(eight, starts, size) + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    left = np.flatnonzero((size > 8) & (size <= LONG_WORD))
    done = 8
    while len(left):
        rest = size[left] - done
        h[left] = mixed((h[left] + np.uint64(_BASE)) ^ block(eight, starts[left] + done, rest))
        left = left[rest > 8]
        done += 8
    for k in np.flatnonzero(size > LONG_WORD).tolist():
        h[k] = xxhash.xxh3_64_intdigest(low[starts[k] : ends[k]].tobytes())
    return h


def word_texts(raw: np.ndarray, at: np.ndarray, starts: np.ndarray, ends: np.ndarray, counts: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Each text's words in turn, A-Z as a-z, parted by one space; and the edges of the texts."""
    low = _LOWER[raw]
    keep = np.logical_not(_SPACE[raw])
    inner = np.ones(len(ends), bool)
    inner[(np.cumsum(counts) - 1)[counts > 0]] = False
    keep[ends[inner]] = True
    low[ends[inner]] = 32
    return low[keep].tobytes(), np.concatenate([[0], np.cumsum(keep)])[at]


def shingles(hashes: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each run of `width` words of a text, and how many each text has; with fewer words, the whole sequence is its one run; with none, there is none."""
    out_counts = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    ends = np.cumsum(counts)
    first = ends - counts
    low = np.repeat(first - (np.cumsum(out_counts) - out_counts), out_counts) + np.arange(out_counts.sum())
    length = np.repeat(np.minimum(counts, width), out_counts)
    h = np.repeat(np.minimum(counts, width).astype(np.uint64), out_counts) * np.uint64(_BASE)
    for k in range(width):
        has = length > k
        h = np.where(has, mixed(h + hashes[np.minimum(low + k, max(len(hashes) - 1, 0))] * np.uint64(0xA0761D6478BD642F + 2 * k)), h) if len(hashes) else h
    return h, out_counts
