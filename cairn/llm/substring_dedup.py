"""Removal of repeated byte strings by suffix arrays of shards.

Every WIDTH-byte window of a text is keyed by the least hash of its 64-byte strings. Equal windows
have equal keys, and a key holds over a run of neighbouring windows: the run's bytes are a segment.
So all windows of a key can be looked at in one place, and a key met once needs no look at all.
Segments are counted by key and digest. One that occurs twice is repeated as a whole; of the others,
one of each digest goes to a shard, where induced sorting and permuted common prefixes tell which of
its windows also start elsewhere. Segments of a key with more of them than a shard takes are cut into
pieces keyed by the core that a piece's windows share, all but a few of their bytes; pieces of a
core that is hot still are cut into single windows. Work stays linear in segments: nothing is capped
and no two blocks of a key are paired.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import ROW, discard, mixed, numbered, slices, staged, text_rows, utf8
from .graph import runs
from .suffix_array import repeated

WIDTH = 200
#: Bytes of a key's string, a power of two; less where windows are shorter than two of them.
GRAM = 64
#: Windows of a segment at most: longer runs, as of one repeated byte, are cut.
RUN = 2048
#: Segments of one key that are sorted as they are; pieces that the windows of any others are cut into.
KEY_SEGMENTS, STEPS = 1024, 8
#: Segments of hot keys, by count, up to which their places are sent to all tasks; beyond it texts are dealt out to meet them.
BROADCAST_SEGMENTS = 200_000
SHARD_BYTES = 512 << 10


def _gram(width: int) -> int:
    gram = GRAM
    while 2 * gram > max(width, 2):
        gram //= 2
    return gram


def _gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """Of the string of `gram` bytes at each place; strings that collide share a key, and are told apart by their bytes."""
    h = raw.astype(np.uint64) + np.uint64(1)
    step, base = 1, 0x9E3779B97F4A7C15
    while step < gram:
        h = h[:-step] * np.uint64(base) + h[step:]
        base, step = base * base & 0xFFFFFFFFFFFFFFFF, 2 * step
    return mixed(h)


def segments(raw: np.ndarray, at: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, first byte in the text, windows, key and self of each segment; self: whether its key's string occurs in it twice, so that its windows may equal each other."""
    gram = _gram(width)
    n, span = len(raw), width - gram + 1
    none = np.zeros(0, np.int64)
    if n < width:
        return none, none, none, none, none.astype(bool)
    h = _gram_hashes(raw, gram)

    def sliding(x: np.ndarray, size: int, pick) -> np.ndarray:
        done = 1
        while 2 * done <= size:
            x = pick(x[:-done], x[done:])
            done *= 2
        return pick(x[: len(x) - (size - done)], x[size - done :]) if done < size else x

    least = sliding(h, span, np.minimum)
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(least)]
    valid = np.arange(len(least)) + width <= at[text + 1]
    key = np.where(valid, least, np.uint64(0))
    # Strings that are the least of some window, and those of them that recur near by.
    reach = sliding(np.concatenate([np.zeros(span - 1, np.uint64), key, np.zeros(span - 1, np.uint64)]), span, np.maximum)
    chosen = np.flatnonzero(reach[: len(h)] == h)
    order = chosen[np.lexsort((chosen, h[chosen]))]
    near = (h[order[1:]] == h[order[:-1]]) & (order[1:] - order[:-1] < 2 * span)
    ties = np.unique(h[order[1:][near]])
    first = valid.copy()
    first[1:] &= (key[1:] != key[:-1]) | (text[1:] != text[:-1])
    starts = np.flatnonzero(first)
    stops = np.append(starts[1:], len(least))
    inside = np.cumsum(np.concatenate([[0], valid]))
    size = inside[stops] - inside[starts]
    if (size > RUN).any():
        parts = -(-size // RUN)
        offset = (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)) * RUN
        starts, size = np.repeat(starts, parts) + offset, np.minimum(np.repeat(size, parts) - offset, RUN)
    return text[starts], starts - at[text[starts]], size, key[starts].view(np.int64), np.isin(key[starts], ties)


#: A place: first byte, windows and self in one number.
_SIZE = 12


def _segment_rows(docs: DataFrame, width: int) -> DataFrame:
    """key, digest, doc, place of every segment."""

    def cut(batches):
        for batch in batches:
            for part in slices(batch, 1, 1 << 20):
                raw, at = utf8(part.column(1))
                text, low, size, key, own = segments(raw, at, width)
                data, begin = raw.tobytes(), (at[text] + low).tolist()
                digest = np.fromiter((xxhash.xxh3_64_intdigest(data[a : a + k + width - 1]) for a, k in zip(begin, size.tolist(), strict=True)), np.uint64, len(begin)).view(np.int64)
                doc = part.column(0).to_numpy(zero_copy_only=False)[text] if len(text) else np.zeros(0, np.int64)
                place = low << (_SIZE + 1) | own.astype(np.int64) << _SIZE | size
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, digest, doc.astype(np.int64), place)], names=["key", "digest", "doc", "place"])

    return docs.select("doc", "text").mapInArrow(cut, "key long, digest long, doc long, place long")


def _spans(rows: DataFrame, width: int) -> DataFrame:
    """doc, low, high (bytes) of whole segments."""
    low, size = F.shiftright("place", _SIZE + 1), F.col("place").bitwiseAND((1 << _SIZE) - 1)
    return rows.select("doc", low.alias("low"), (low + size + width - 1).alias("high"))


def repeated_spans(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc, low, high: byte spans covered by `width`-byte strings that start in more than one place; docs: doc (one number a row), text, and others that are carried along. Spans may overlap."""
    every = staged(_segment_rows(docs, width), "segments")
    own = F.shiftright("place", _SIZE).bitwiseAND(1) == 1
    # Sums are staged before they are joined back: the joins then deal out both sides anew, and a key
    # of most rows can be split.
    keys = staged(every.groupBy("key").agg(F.count("*").alias("n"), F.max(own).alias("own")).where("n > 1 OR own").select("key"), "keys")
    met = staged(every.join(keys.hint("merge"), "key"), "met")
    discard(every)
    discard(keys)
    texts = met.groupBy("key", "digest").agg(F.count("*").alias("n"), F.max(own).alias("own"), F.min(F.struct("doc", "place")).alias("one"))
    texts = staged(texts.select("key", "digest", "n", "own", "one.*"), "texts")
    kinds = staged(texts.groupBy("key").agg(F.count("*").alias("kinds")).where("kinds > 1"), "kinds")
    told = texts.join(kinds.hint("merge"), "key", "left").withColumn("kinds", F.coalesce("kinds", F.lit(1)))
    whole = met.join(texts.where("n > 1").select("key", "digest").hint("merge"), ["key", "digest"])
    # A segment met once is looked at if its key has others, or repeats within it.
    looked = told.where("kinds > 1 OR (own AND n = 1)")
    hot = F.col("kinds") > KEY_SEGMENTS
    cold, spans = _fetched(docs, looked.where(~hot), width), _spans(whole, width)
    most = kinds.where(hot).agg(F.coalesce(F.sum("kinds"), F.lit(0))).first()[0]
    if not most:
        return spans.unionByName(_sorted_shards(cold, width))
    # Hot keys: pieces whose windows share nearly all of their bytes, and of those that are hot still,
    # windows one by one. Both are counted by digests, within tasks first.
    pieces = staged(_cut_rows(_fetched(docs, looked.where(hot), width, most <= BROADCAST_SEGMENTS), width, lambda raw, key: cores(raw, key, width)), "pieces")
    texts = staged(pieces.where("n > 0").groupBy("key", "digest").agg(F.sum("n").alias("n"), F.min(F.struct("doc", "low")).alias("one"), F.any_value("bytes").alias("bytes")), "piece-texts")
    kinds = staged(texts.groupBy("key").agg(F.count("*").alias("kinds")).where("kinds > 1"), "piece-kinds")
    looked = texts.join(kinds.hint("merge"), "key").select("key", "kinds", "n", "one.*", "bytes")
    windows = staged(_cut_rows(looked.where(hot), width, lambda raw, key: ((k, 1, raw[k : k + width]) for k in range(len(raw) - width + 1))).drop("bytes"), "windows")
    counts = staged(windows.where("n > 0").groupBy("key", "digest").agg(F.sum("n").alias("n")), "window-counts")
    for rows, sums in ((pieces, texts), (windows, counts)):
        met = rows.where("n = 1").join(sums.where("n > 1").select("key", "digest").hint("merge"), ["key", "digest"])
        spans = spans.unionByName(rows.where("n = 0").select("doc", "low", "high")).unionByName(met.select("doc", "low", "high"))
    return spans.unionByName(_sorted_shards(cold.unionByName(looked.where(~hot).select("key", "n", "doc", "low", "bytes")), width))


def _fetched(docs: DataFrame, looked: DataFrame, width: int, small: bool = False) -> DataFrame:
    """key, n, doc, low, bytes of segments (key, n, doc, place); small: whether there are few enough of them to be sent to all tasks."""
    by_doc = looked.groupBy("doc").agg(F.collect_list(F.struct("key", "n", "place")).alias("wanted"))
    # All columns, as the join that strips the texts has them: the texts are then dealt out once for both.
    held = docs.join(F.broadcast(by_doc) if small else by_doc.hint("merge"), "doc").select(*docs.columns, "wanted")
    columns = [held.columns.index(c) for c in ("doc", "text", "wanted")]

    def fetch(batches):
        for batch in batches:
            for doc, text, wanted in zip(*(batch.column(k) for k in columns), strict=True):
                raw, out = text.as_py().encode(), []
                for x in wanted.as_py():
                    low, size = x["place"] >> (_SIZE + 1), x["place"] & (1 << _SIZE) - 1
                    out.append((x["key"], x["n"], doc.as_py(), low, raw[low : low + size + width - 1]))
                names = ["key", "n", "doc", "low", "bytes"]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == 4 else pa.int64()) for k, c in enumerate(zip(*out, strict=True))], names=names)

    return held.mapInArrow(fetch, "key long, n long, doc long, low long, bytes binary")


def cores(raw: bytes, key: int, width: int) -> list[tuple[int, int, bytes]]:
    """First window, windows and core of each piece of a segment: a run of windows that have the key's string first at one place, at one step of distances to their ends. The core is what those windows share.

    Equal windows have that string at one distance, so they are in pieces of one core; two windows of
    a piece have it at different ones, so they are never equal.
    """
    gram = _gram(width)
    h = _gram_hashes(np.frombuffer(raw, np.uint8), gram).view(np.int64)
    at = np.flatnonzero(h == key)
    window = np.arange(len(raw) - width + 1)
    place = at[np.searchsorted(at, window)]
    step = max(1, (width - gram) // STEPS)
    which = (window + width - place - gram) // step
    first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (which[1:] != which[:-1])]))
    out = []
    for a, z in zip(first.tolist(), [*first[1:].tolist(), len(window)], strict=True):
        p, j = int(place[a]), int(which[a])
        left = max(0, width - gram - step * j - (step - 1))  # bytes before the string that all windows of this step have
        out.append((a, z - a, raw[p - left : p + gram + step * j] + j.to_bytes(2, "little")))
    return out


def _cut_rows(rows: DataFrame, width: int, cut) -> DataFrame:
    """key, digest, n, doc, low, high, bytes of the pieces that cut(bytes, key) gives as (first window, windows, core): the key is that of the core, the digest that of the piece.

    Pieces alike are added up before they leave a task: one that a few segments, or one that repeats
    within itself, have twice is a row for the others to meet, and its places are rows of n = 0,
    spans that need no more looking, neighbours as one.
    """

    def run(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, 64):
                held: dict[tuple[int, int], list] = {}
                places, spans = [], []
                for key, n, doc, low, raw in zip(*(batch.column(k).slice(begin, 64).to_pylist() for k in range(5)), strict=True):
                    for a, size, core in cut(raw, key):
                        piece = raw[a : a + size + width - 1]
                        name = xxhash.xxh3_64_intdigest(core) - (1 << 63), xxhash.xxh3_64_intdigest(piece, 1) - (1 << 63)
                        held.setdefault(name, [0, doc, low + a, low + a + len(piece), piece])[0] += n
                        if n == 1:
                            places.append((name, doc, low + a, low + a + len(piece)))
                for name, doc, low, high in places:
                    if held[name][0] > 1:
                        if spans and spans[-1][0] == doc and spans[-1][1] <= low <= spans[-1][2]:
                            spans[-1][2] = max(spans[-1][2], high)
                        else:
                            spans.append([doc, low, high])
                out = [(*name, *x) for name, x in held.items()] + [(0, 0, 0, *x, None) for x in spans]
                names = ["key", "digest", "n", "doc", "low", "high", "bytes"]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == 6 else pa.int64()) for k, c in enumerate(zip(*out, strict=True))], names=names)

    return rows.select("key", "n", "doc", "low", "bytes").mapInArrow(run, "key long, digest long, n long, doc long, low long, high long, bytes binary")


def _sorted_shards(parts: DataFrame, width: int) -> DataFrame:
    """doc, low, high of the repeated strings of parts (key, n, doc, low, bytes), found by the suffix arrays of shards of whole keys."""
    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def sort(batches):
        held: list[pa.Table] = []
        size = 0

        def flush():
            table = pa.concat_tables(held)
            out = []
            bits = repeated(table.column("bytes").to_pylist(), width)
            for n, doc, low, hit in zip(*(table.column(c).to_pylist() for c in ("n", "doc", "low")), bits, strict=True):
                if n == 1 and hit.any():  # those met twice are repeated anyway, they are here for the others
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
                    out += [(doc, low + a, low + z + width - 1) for a, z in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)] or [pa.array([], pa.int64())] * 3, names=["doc", "low", "high"])

        # A shard is a run of whole groups: equal strings have equal keys.
        for group in runs(batches, 1):
            held.append(group.select(["n", "doc", "low", "bytes"]))
            size += group.column("bytes").nbytes
            if size >= SHARD_BYTES:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return parts.repartition(n, "key").sortWithinPartitions("key").mapInArrow(sort, "doc long, low long, high long")


def without_repeats(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (binary: what is left), kept_sha256.

    A byte goes if a `width`-byte string of the input that covers it also starts anywhere else, in
    the same text or another; strings never cross texts, and are judged on the input. Null and empty
    texts have 0 bytes; texts under `width` bytes lose none. Rows come out one for one: equal rows,
    even of one id, repeat each other. An empty table gives an empty result. Columns of other names
    are not read. Each row has a number of its own, staged beside its text.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = numbered(text_rows(docs, F.col(id_col).cast("long").alias("doc_id"), text.alias("text")), "texts").withColumnRenamed(ROW, "doc").where("doc IS NOT NULL")
    spans = repeated_spans(rows, width).groupBy("doc").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    joined = rows.join(spans.hint("merge"), "doc", "left").select("doc_id", "text", "spans")

    def strip(batches):
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(1), batch.column(2), strict=True):
                raw, removed, runs_, kept, end = text.as_py().encode(), 0, 0, [], 0
                for x in sorted(((s["low"], s["high"]) for s in spans.as_py() or ()), key=lambda s: s[0]):
                    low, high = x
                    if low > end or not runs_:
                        kept.append(raw[end:low])
                        runs_ += 1
                        end = low
                    removed += max(0, high - end)
                    end = max(end, high)
                left = b"".join([*kept, raw[end:]])
                out.append((len(raw), removed, runs_, left, hashlib.sha256(left).hexdigest()))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    return joined.mapInArrow(strip, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
