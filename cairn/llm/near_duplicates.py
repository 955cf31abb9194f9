"""Near-duplicates by SuperMinHash, banding, verification on full sets, and union-find grouping.

Texts of the same words are one class from the start; a class has one representative. A pair of
representatives meets if a band of their signatures is equal. Within a bucket their 8-bit sketches
decide what may be linked, with a margin of six standard deviations, and only a spanning forest of
that leaves the task: edges stay linear in rows, however large a group of copies is. The components
of those edges are families; in a family the full shingle sets are compared, again all pairs that
could still join two parts, again only a spanning forest leaving. Buckets and families beyond a
task's size are cut into blocks; what hubs do not join meets every other block: no link is lost to
a cap, and a large group of copies costs what it holds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import superminhash
from .common import shingles, slices, staged, text_rows, utf8, word_hashes, word_texts, words
from .graph import linked_groups, runs, spanning

#: Values of a signature, and the chance that a pair at the threshold may share no band: at 0.85 that is 40 bands of 6.
SLOTS, MISSED = 240, 1e-8
SKETCH = 128
#: Rows of a bucket or a family that one task compares, and shingles that count as one row.
BUCKET, FAMILY, SHINGLES = 512, 1024, 2048


def _sets(raw: np.ndarray, at: np.ndarray, width: int) -> tuple[list[np.ndarray], list[bytes]]:
    """Each text's distinct shingles, sorted, and its words in turn."""
    starts, ends, counts = words(raw, at)
    each, n = shingles(word_hashes(raw, starts, ends), counts, width)
    joined, edges = word_texts(raw, at, starts, ends, counts)
    return [np.unique(each[z - k : z]) for k, z in zip(n, np.cumsum(n), strict=True)], [joined[a:z] for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


def band_rows(similarity: float, slots: int = SLOTS) -> int:
    """The most values to a band with which a pair of this similarity is missed no more often than MISSED."""
    return max((r for r in range(1, slots + 1) if slots % r == 0 and (1 - similarity**r) ** (slots // r) <= MISSED), default=1)


def profiles(docs: DataFrame, id_col: str, text_col: str, width: int, rows: int, slots: int = SLOTS) -> DataFrame:
    """doc_id, digest (of the text as it is), h1 and h2 (128 bits of the word sequence), n_shingles, bands, sketch."""

    def profile(batches):
        for batch in batches:
            for part in slices(batch, 2):
                sets, sequences = _sets(*utf8(part.column(2)), width)
                counts = np.array([len(x) for x in sets])
                signature = superminhash.signatures(np.concatenate(sets) if sets else np.zeros(0, np.uint64), counts, slots)
                digests = b"".join(xxhash.xxh3_128_digest(x) for x in sequences)
                h = np.frombuffer(digests, "<i8").reshape(-1, 2)
                band = superminhash.bands(signature, rows).view(np.int64)
                offsets = pa.array(np.concatenate([[0], np.cumsum(np.where(counts > 0, band.shape[1], 0))]).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(band[counts > 0].reshape(-1)))
                sketch = superminhash.sketch(signature[:, :SKETCH])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), pa.array(counts, pa.int64()), lists, pa.array([x.tobytes() if n else None for x, n in zip(sketch, counts, strict=True)], pa.binary())], names=["doc_id", "digest", "h1", "h2", "n_shingles", "bands", "sketch"])

    texts = text_rows(docs, F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("digest"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(profile, "doc_id long, digest long, h1 long, h2 long, n_shingles long, bands array<long>, sketch binary")


def _dealt(rows: DataFrame, keys: list[str]) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *keys).sortWithinPartitions(*keys, "id")


def _forest(edges: list[tuple[int, int]], ids: np.ndarray) -> pa.RecordBatch:
    pairs = np.array(edges, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(ids[pairs[:, 0]]), pa.array(ids[pairs[:, 1]])], names=["a", "b"])


def _gathered(parts, most: int = 4096):
    held = []
    for x in parts:
        held.append(x)
        if len(held) >= most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def sketch_edges(members: DataFrame, least: int) -> DataFrame:
    """a, b: for each (bucket, i, j) of rows id, sketch, a spanning forest of the pairs whose sketches agree in `least` places."""

    def link(batches):
        def each():
            for group in runs(batches, 3):
                ids = group.column("id").to_numpy()
                if len(ids) < 2:
                    continue
                table = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint8).reshape(len(ids), -1)
                if edges := spanning(len(ids), lambda x, rest: (table[rest] == table[x]).sum(axis=1) >= least):
                    yield _forest(edges, ids)

        yield from _gathered(each())

    return _dealt(members.select("bucket", "i", "j", "id", "sketch"), ["bucket", "i", "j"]).mapInArrow(link, "a long, b long")


def linked(sets: list[np.ndarray], per: int, of: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sets with of * |intersection| >= per * |union|."""
    sizes = np.array([len(x) for x in sets], np.int64)
    _, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    shared = times[place] > 1
    # Elements that only one set here has are in no intersection; a set with too many of them has no link.
    common = np.bincount(owner[shared], minlength=len(sets))
    able = np.flatnonzero(of * common >= per * sizes)
    if len(able) < 2:
        return []
    keep = shared & np.isin(owner, able)
    place, sizes = place[keep], sizes[able]
    starts = np.concatenate([[0], np.cumsum(common[able])])
    mark = np.zeros(len(times), np.int32)

    def similar(x: int, rest: np.ndarray) -> np.ndarray:
        mine = place[starts[x] : starts[x + 1]]
        mark[mine] = 1
        both = np.add.reduceat(mark[place], starts[:-1])[rest]
        mark[mine] = 0
        return of * both >= per * (sizes[rest] + sizes[x] - both)

    return [(int(able[a]), int(able[b])) for a, b in spanning(len(able), similar)]


def set_edges(members: DataFrame, width: int, per: int, of: int) -> DataFrame:
    """a, b: for each (family, i, j) of rows id, text, a spanning forest of the pairs whose full shingle sets are linked."""

    def link(batches):
        def each():
            for group in runs(batches, 3):
                ids = group.column("id").to_numpy()
                if len(ids) < 2:
                    continue
                sets = []
                for part in group.select(["id", "text"]).combine_chunks().to_batches():
                    for some in slices(part, 1):
                        sets += _sets(*utf8(some.column(1)), width)[0]
                if edges := linked(sets, per, of):
                    yield _forest(edges, ids)

        yield from _gathered(each())

    return _dealt(members.select("family", "i", "j", "id", "text"), ["family", "i", "j"]).mapInArrow(link, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, per: int = 85, of: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable over links), kept (doc_id = component_id).

    Words are runs of non-space characters with A-Z as a-z; a set has the text's distinct runs of
    `width` words, or its whole sequence where it is shorter. Two documents are linked if
    of * |intersection| >= per * |union|, on full sets. Null and empty texts and those of spaces have
    an empty set, no links, and are kept. Rows come out one for one, n_shingles of each row's own text;
    rows of one id count as one document, linked by any of their texts; a null id is linked with
    nothing and kept. An empty table gives an empty result. Columns of other names are not read.
    """
    # A row's own number: ids may repeat, and the row that stands for a class must be one.
    seen = staged(profiles(docs, id_col, text_col, width, band_rows(per / of)).withColumn("row", F.monotonically_increasing_id()), "profiles")
    known = seen.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # Staged, so that the joins deal out both sides anew and a class of most rows can be split.
    classes = staged(known.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.min_by("row", "doc_id").alias("node")), "classes")
    reps = staged(known.join(classes.select("h1", "h2", "node").hint("merge"), ["h1", "h2"]).where("row = node").select(F.col("node").alias("id"), "doc_id", "digest", "n_shingles", "bands", "sketch"), "reps")
    banded = reps.select("id", F.explode("bands").alias("bucket"))
    # Buckets of the same members, as the bands of a small family are, are looked at once.
    sums = banded.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("y")).where("n > 1")
    buckets = sums.groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", "n")
    least = int(SKETCH * per / of - 6 * (SKETCH * per / of * (1 - per / of)) ** 0.5)
    lean = staged(banded.join(buckets.hint("merge"), "bucket"), "members")
    alike = linked_groups(lean, "bucket", "n", "id", "id", BUCKET, lambda rows: rows.join(reps.select("id", "sketch").hint("merge"), "id"), lambda rows: sketch_edges(rows, least))
    families = staged(alike.select(F.col("component").alias("family"), "id").join(reps.select("id", "doc_id", "digest", "n_shingles").hint("merge"), "id"), "families")
    # A family's size is its rows, or its shingles where those are many to a row: it bounds what a task holds.
    sizes = staged(families.groupBy("family").agg(F.greatest(F.count("*"), F.ceil(F.sum("n_shingles") / SHINGLES)).alias("n")), "family-sizes")
    named = staged(families.join(sizes.hint("merge"), "family").select("family", "n", F.col("id").alias("row"), F.col("doc_id").alias("id"), "digest"), "named")
    texts = text_rows(docs, F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("digest"), F.col(text_col).cast("string").alias("text"))

    def carried(rows: DataFrame) -> DataFrame:
        """With texts: families grow with the corpus, never a side to broadcast. Of repeated rows one is read, in the order and the tasks of the join."""
        return texts.join(rows.hint("merge"), ["id", "digest"]).dropDuplicates(["id", "digest"])

    # An id of several texts is in the class of each.
    owned = staged(seen.select("doc_id", "h1", "h2", "n_shingles").join(classes.select("h1", "h2", "rep").hint("merge"), ["h1", "h2"], "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("rep")), "owned")
    several = staged(owned.where("rep IS NOT NULL").groupBy("doc_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high").select("doc_id"), "several")
    same = owned.join(several.hint("merge"), "doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    found = linked_groups(named, "family", "n", "row", "id", FAMILY, carried, lambda rows: set_edges(rows, width, per, of), same)
    rows = owned.join(found.select(F.col("id").alias("rep"), "component").hint("merge"), "rep", "left")
    return rows.select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with one document of each group left, columns as they were.

    Of several rows of a kept id the one whose text has the least hash stays, as one document is one
    row. Rows of a null id are linked with nothing and all stay.
    """
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col(f"`{id_col}`").cast("long").alias("_id"), F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("_tie"))
    gone = near_duplicates(docs, id_col, text_col, **how).where(~F.col("kept")).select(F.col("doc_id").alias("_id"))
    left = held.where("_id IS NOT NULL").join(gone.hint("merge"), "_id", "left_anti")
    # Dealt out and sorted by the join already: rows of an id stream by, and one is held.
    one = left.groupBy("_id").agg(F.min_by("_row", "_tie").alias("_row")).select("_row")
    return one.unionByName(held.where("_id IS NULL").select("_row")).select("_row.*")
