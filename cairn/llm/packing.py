"""Conflict-constrained best-fit packing of documents into bins of equal capacity.

Documents are dealt into shards by a hash, so shards are alike whatever sources or copies the table
holds, and a task packs one shard at a time. Items go in order of falling size. Bins stand in order
of residual capacity; each carries bitmaps of the sources and of the duplicate clusters that it
holds. The search begins at the least residual that the item fits and goes on to the next until a
bin has no conflict: the tightest compatible bin. Bins of equal residual and sources are held
together, so that one look passes over all that a source excludes.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import staged
from .graph import runs
from .source_mixing import word_count

CAPACITY = 2048
SHARD_ROWS = 1024


class Packer:
    """Bins of one shard. `per_source`: how many items of one source a bin may hold; one of a cluster."""

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.residual: list[int] = []
        self.clusters: list[int] = []
        self.items: list[int] = []
        self._open: dict[int, dict[tuple[int, ...], list[int]]] = {}
        self._ahead = 0  # bit r: a bin of residual r is open

    def _put(self, bin_: int, planes: tuple[int, ...]) -> None:
        r = self.residual[bin_]
        if r:
            self._open.setdefault(r, {}).setdefault(planes, []).append(bin_)
            self._ahead |= 1 << r

    def _found(self, size: int, source: int, cluster: int) -> tuple[int, tuple[int, ...]] | None:
        ahead = self._ahead >> size << size
        while ahead:
            r = (ahead & -ahead).bit_length() - 1
            groups = self._open[r]
            for planes, bins in groups.items():
                if planes[-1] & source:
                    continue
                for k, bin_ in enumerate(bins):
                    if not self.clusters[bin_] & cluster:
                        del bins[k]
                        if not bins:
                            del groups[planes]
                            if not groups:
                                del self._open[r]
                                self._ahead ^= 1 << r
                        return bin_, planes
            ahead &= ahead - 1
        return None

    def add(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """The bin and place in it of an item; source and cluster: one bit each, or 0 for none."""
        if found := self._found(size, source, cluster):
            bin_, planes = found
        else:
            bin_, planes = len(self.residual), (0,) * self.per_source
            self.residual.append(self.capacity)
            self.clusters.append(0)
            self.items.append(0)
        self.residual[bin_] -= size
        self.clusters[bin_] |= cluster
        carry, out = source, []
        for plane in planes:
            out.append(plane | carry)
            carry &= plane
        self._put(bin_, tuple(out))
        self.items[bin_] += 1
        return bin_, self.items[bin_] - 1


def pack(
    docs: DataFrame, capacity: int = CAPACITY, per_source: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster: Column | None = None, size: Column | None = None, seed: int = 0, shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """doc_id, size, piece, begin, end (words of the text), bin, place, filled (words in the bin).

    size: the words of the text unless given. A document beyond the capacity is cut: full pieces
    have a bin each, the rest is packed like any other. A bin holds at most `per_source` packed
    pieces of a source (null is a source) and one of a duplicate cluster (equal texts unless a
    cluster is given; a null cluster conflicts with none). Null and empty texts have one row of piece
    0 without words or bin. Repeated and null ids are packed as rows of their own. Ties go by id, then
    by cluster. An empty table gives an empty result. Columns of other names are not read.
    """
    text = F.col(text_col).cast("string")
    cluster = F.xxhash64(text) if cluster is None else cluster.cast("long")
    words = word_count(text) if size is None else F.coalesce(size.cast("long"), F.lit(0))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(source_col).cast("string"), F.lit("\0"))).alias("source"), cluster.alias("cluster"), words.alias("size"))
    rows = staged(rows, "items")
    shards = max(1, -(-rows.count() // shard_rows))
    shard = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "cluster"), F.lit(shards)).cast("long")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("shard", shard).withColumn("rest", F.col("size") % F.lit(capacity))
    dealt = dealt.select("shard", "rest", "doc_id", "source", "cluster", "size").repartition(n, "shard").sortWithinPartitions("shard", F.desc("rest"), "doc_id", "cluster")

    def fill(batches):
        for group in runs(batches, 1):
            number = group.column("shard")[0].as_py()
            packer, out, full = Packer(capacity, per_source), [], []
            sources: dict[int, int] = {}
            clusters: dict[int, int] = {}
            for doc_id, source, own, n_words in zip(*(group.column(c).to_pylist() for c in ("doc_id", "source", "cluster", "size")), strict=True):
                whole, rest = divmod(n_words, capacity)
                full += [(doc_id, n_words, k) for k in range(whole)]
                if rest:
                    bits = 1 << sources.setdefault(source, len(sources)), 0 if own is None else 1 << clusters.setdefault(own, len(clusters))
                    out.append((doc_id, n_words, whole, whole * capacity, n_words, *packer.add(rest, *bits)))
                elif not whole:
                    out.append((doc_id, 0, 0, 0, 0, None, None))
            bins = len(packer.residual)
            out += [(d, w, k, k * capacity, (k + 1) * capacity, bins + j, 0) for j, (d, w, k) in enumerate(full)]
            filled = [capacity - r for r in packer.residual] + [capacity] * len(full)
            columns = list(zip(*out, strict=True))
            columns[5] = [None if b is None else (number << 24) + b for b in columns[5]]
            columns.append([None if x[5] is None else filled[x[5]] for x in out])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "size", "piece", "begin", "end", "bin", "place", "filled"])

    return dealt.mapInArrow(fill, "doc_id long, size long, piece long, begin long, end long, bin long, place long, filled long")


def fill_rate(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """n_bins, n_words and the part of all capacity that is filled."""
    bins = packed.where("bin IS NOT NULL").groupBy("bin").agg(F.max("filled").alias("filled"))
    return bins.agg(F.count("*").alias("n_bins"), F.sum("filled").alias("n_words"), (F.sum("filled") / (F.count("*") * capacity)).alias("rate"))
