"""Mixing sources to target weights by Sainte-Laguë apportionment.

Targets are global: a share of the mix for each source, by weight, with a ceiling of so many passes
over it. A source's documents are dealt into shards of like size by a hash, and a shard's words are
blocks of equal size. The sources win as many blocks as the mix holds by highest quotients; a
source's blocks go to groups of its shards, and those of a group to its shards, by highest quotients
again. So quotas are whole blocks in every shard and no step loses any to rounding. Within a shard
whole passes come first and the rest are blocks picked by a seeded order. All of it is decided by
ids, texts and the seed.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from .common import SPACE_RUN, SPACES, WORD, fenced, staged, text_rows
from .graph import runs

BLOCK = 64
#: A shard has so many blocks at least, smaller ones where its words are few, so that rounding to blocks stays under a hundredth.
LEAST_BLOCKS = 256
PASSES = 2
SHARD_ROWS = 512
#: Shards of a source that are apportioned in one step.
GROUP = 4096
#: A table of more sources than this is never broadcast.
BROADCAST_SOURCES = 10_000
_PARTS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
_OUT = ["doc_id", "source", "size", "source_size", "target", "shard", "passes", "parts", "taken"]


def word_count(text: Column) -> Column:
    """Number of words, as Spark's own expression; null has 0."""
    bare = F.trim(text, F.lit(SPACES.decode()))
    return F.when(text.isNull() | (bare == ""), F.lit(0)).otherwise(F.size(F.split(bare, SPACE_RUN))).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[int], share: Fraction, passes: int = PASSES) -> list[Fraction]:
    """Each source's target: its weight's part of share * sum(sizes), at most passes * its size; what is over goes to the others by weight until none is above."""
    total, out, free = share * sum(sizes), [Fraction(0)] * len(sizes), set(range(len(sizes)))
    while free:
        left = total - sum(out[k] for k in range(len(sizes)) if k not in free)
        weight = sum(weights[k] for k in free)
        for k in free:
            out[k] = left * weights[k] / weight
        over = {k for k in free if out[k] > passes * sizes[k]}
        for k in over:
            out[k] = Fraction(passes * sizes[k])
        free -= over
        if not over:
            break
    return out


def apportioned(votes: Sequence[float], seats: int, most: Sequence[int]) -> list[int]:
    """Sainte-Laguë: seats go one by one to the highest votes / (2 * seats so far + 1), ties to the first, none beyond `most`.

    The seats that any order of quotients gives first are dealt at once: with a divisor at which
    rounding gives too few seats, everyone surely gets what rounding gives.
    """
    votes = [float(v) for v in votes]
    total = sum(votes)
    got = [0] * len(votes)
    if total <= 0:
        return got
    divisor = total / max(1, seats - 2 * len(votes)) if seats > 2 * len(votes) else float("inf")
    if divisor != float("inf"):
        got = [min(m, int(v / divisor + 0.5)) for v, m in zip(votes, most, strict=True)]
        while sum(got) > seats:
            divisor *= 1.05
            got = [min(m, int(v / divisor + 0.5)) for v, m in zip(votes, most, strict=True)]
    heap = [(-v / (2 * g + 1), k) for k, (v, g, m) in enumerate(zip(votes, got, most, strict=True)) if v > 0 and g < m]
    heapq.heapify(heap)
    for _ in range(seats - sum(got)):
        if not heap:
            break
        _, k = heap[0]
        got[k] += 1
        if got[k] < most[k]:
            heapq.heapreplace(heap, (-votes[k] / (2 * got[k] + 1), k))
        else:
            heapq.heappop(heap)
    return got


def block_count(size, block: int = BLOCK, least: int = LEAST_BLOCKS):
    """How many equal blocks a shard of so many words is cut into: of `block` words but for rounding, `least` blocks or as many as there are words."""
    return np.maximum((2 * size + block) // (2 * block), np.minimum(size, least))


def _blocks(size: Column, block: int) -> Column:
    """`block_count` as Spark's own expression."""
    return F.greatest(F.floor((2 * size + block) / (2 * block)).cast("long"), F.least(size, F.lit(LEAST_BLOCKS).cast("long")))


def source_targets(rows: DataFrame, weights: Sequence[int], share: Fraction, passes: int = PASSES) -> tuple[DataFrame, int]:
    """source, rank, source_size, n_rows, target of each source of rows (source, size), staged; and how many there are.

    As `targets`, for any number of sources: ranks come from ranges of sources with one count for
    each range, and what a unit of weight gets is raised until no source is above its ceiling, by
    two sums over the sources at a time. Only those sums reach the driver.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.col("source").asc_nulls_last()
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    placed = staged(sums.repartitionByRange(n, key).sortWithinPartitions(key).withColumn("place", F.monotonically_increasing_id()), "sources")
    part, offsets, before, total = F.shiftright("place", 33), [], 0, 0
    for r in sorted(placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.sum("source_size").alias("size")).collect(), key=lambda r: r.part):
        offsets.append((r.part, before))
        before, total = before + r.n, total + r["size"]
    starts = spark.createDataFrame(offsets, "part long, before long")
    ranked = placed.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("rank", F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1))
    turn = (F.col("rank") % len(weights)).cast("int") + 1
    known = ranked.withColumn("weight", F.element_at(F.array(*(F.lit(w).cast("long") for w in weights)), turn))
    goal, level = share * total, None

    def above(x: Fraction) -> Column:
        wide = lambda v: F.lit(Decimal(v)).cast("decimal(25,0)")
        return wide(x.numerator) * F.col("weight").cast("decimal(12,0)") > wide(x.denominator * passes) * F.col("source_size").cast("decimal(12,0)" if total < 10**12 else "decimal(18,0)")

    while before:
        capped = F.lit(False) if level is None else above(level)
        r = known.agg(F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0)).alias("w"), F.coalesce(F.sum(F.when(capped, F.col("source_size"))), F.lit(0)).alias("n")).first()
        if not r.w or (then := (goal - passes * r.n) / r.w) == level:
            break
        level = then
    level = level or Fraction(0)
    each = F.element_at(F.array(*(F.lit(float(level * w)) for w in weights)), turn)
    ceiling = (F.col("source_size") * passes).cast("double")
    target = F.when(above(level), ceiling).otherwise(F.least(each, ceiling)) if before else F.lit(0.0)
    return staged(known.select("source", "rank", "source_size", "n_rows", target.alias("target")), "targets"), before


def source_quotas(known: DataFrame) -> DataFrame:
    """rank, quota: as many blocks as all votes make (rank, votes, blocks_most), by highest quotients votes / (2 * seats so far + 1).

    Rounding gives each source its quotients of a half and more; what that gives too few or too many
    are the next quotients below or the last above, in order, ties to the first.
    """
    got = known.withColumn("quota", F.least(F.floor(F.col("votes") + 0.5).cast("long"), F.col("most")))
    sums = got.agg(F.coalesce(F.sum("votes"), F.lit(0.0)).alias("v"), F.coalesce(F.sum("quota"), F.lit(0)).alias("q")).first()
    more = int(sums.v + 0.5) - int(sums.q)
    if not more:
        return got.select("rank", "quota")
    able, step = ("quota < most AND votes > 0", 1) if more > 0 else ("quota > 0", -1)
    quotient = F.col("votes") / (2 * F.col("quota") + step)
    turn = [F.desc(quotient), "rank"] if more > 0 else [quotient.asc(), F.desc("rank")]
    changed = got.where(able).orderBy(*turn).limit(abs(more)).select("rank", F.lit(step).alias("step"))
    return got.join(changed, "rank", "left").select("rank", (F.col("quota") + F.coalesce("step", F.lit(0))).alias("quota"))


def _picked(sizes: np.ndarray, quota: int, block: int, seed: int, key: int) -> tuple[np.ndarray, np.ndarray, list[list[tuple[int, int]]]]:
    """Whole passes, words taken, and word ranges of the picked blocks, of each document; equal blocks cover the documents end to end."""
    n = int(sizes.sum())
    blocks = int(block_count(np.int64(n), block))
    passes, rest = divmod(quota, blocks) if blocks else (0, 0)
    taken = sizes * passes
    parts: list[list[tuple[int, int]]] = [[] for _ in sizes]
    if rest:
        with np.errstate(over="ignore"):
            h = (np.arange(blocks, dtype=np.uint64) + np.uint64((seed * 1_000_003 + key) & (2**63 - 1))) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        chosen = np.sort(np.argsort(h ^ (h >> np.uint64(32)), kind="stable")[:rest])
        low, high = chosen * n // blocks, (chosen + 1) * n // blocks
        ends = np.cumsum(sizes)
        for k, (end, size) in enumerate(zip(ends.tolist(), sizes.tolist(), strict=True)):
            begin = end - size
            for b in range(int(np.searchsorted(high, begin, "right")), int(np.searchsorted(low, end, "left"))):
                a, z = max(begin, int(low[b])) - begin, min(end, int(high[b])) - begin
                if parts[k] and parts[k][-1][1] == a:
                    parts[k][-1] = (parts[k][-1][0], z)
                else:
                    parts[k].append((a, z))
                taken[k] += z - a
    return np.full(len(sizes), passes), taken, parts


def mix_sources(
    docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: Fraction = Fraction(3, 2), seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size: Column | None = None, block: int = BLOCK, passes: int = PASSES, shard_rows: int = SHARD_ROWS, carry: bool = False
) -> DataFrame:
    """doc_id, size, source, source_size, target, shard, passes, parts (word ranges taken once more), taken.

    Sources in code-point order, null last, weigh `weights` in turn and share `share` of all sizes;
    a target stops at `passes` times its source. `size` is the words of the text unless given; null
    and empty texts have size 0 and are taken 0 times. taken never exceeds passes * size. A source's
    taken words differ from its target by rounding to blocks, once for all its shards. Rows come out
    one for one; rows alike in id and text are told apart by nothing. `carry`: each row comes with
    all columns of docs in one, `_row`, so that nothing has to find it again. An empty table gives an
    empty result. Columns of other names are not read otherwise.

    shard numbers the shards of a source; they grow in number with its rows, about `shard_rows` to
    one, whatever part of all rows a source holds. No table of sources or shards reaches the driver,
    and that of the sources is broadcast only up to BROADCAST_SOURCES.
    """
    spark = docs.sparkSession
    text = F.col(f"`{text_col}`").cast("string")
    words = word_count(text) if size is None else F.coalesce(size.cast("long"), F.lit(0))
    lean = [F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), words.alias("size"), F.xxhash64(text).alias("tie")]
    rows = staged(docs.select(*lean), "sizes")
    known, n_sources = source_targets(rows, weights, share, passes)
    told = known.select(F.col("source").alias("_source"), "rank", "source_size", "target", F.ceil(F.col("n_rows") / shard_rows).alias("_shards"))
    told = F.broadcast(told) if n_sources <= BROADCAST_SOURCES else told.hint("merge")
    in_shards = lambda df: df.join(told, F.col("source").eqNullSafe(F.col("_source"))).withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "tie"), F.col("_shards")).cast("long"))
    dealt = in_shards(rows)
    here = dealt.groupBy("rank", "shard").agg(F.sum("size").alias("here"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    cells = staged(here.withColumn("blocks", _blocks(F.col("here"), block)).withColumn("group", F.floor(F.col("shard") / GROUP).cast("long")), "cells")
    groups = staged(cells.groupBy("rank", "group").agg(F.sum("blocks").alias("blocks"), F.first("source_size").alias("source_size"), F.first("target").alias("target")), "groups")
    # A source's votes are its target in blocks of its own.
    votes = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size") * F.col("blocks")).otherwise(0.0)
    sums = groups.groupBy("rank").agg(F.sum("blocks").alias("blocks"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    by_source = source_quotas(sums.select("rank", votes.alias("votes"), (F.col("blocks") * passes).alias("most")))

    def shared(key: str):
        def share_out(parts: pd.DataFrame) -> pd.DataFrame:
            parts = parts.sort_values(key)
            blocks = parts["blocks"].to_numpy()
            return parts[["rank", key]].assign(quota=apportioned(blocks, int(parts["quota"].iloc[0]), passes * blocks))

        return share_out

    by_group = groups.select("rank", "group", "blocks").join(by_source, "rank").groupBy("rank").applyInPandas(shared("group"), "rank long, group long, quota long")
    by_shard = cells.select("rank", "group", "shard", "blocks").join(by_group, ["rank", "group"]).groupBy("rank", "group").applyInPandas(shared("shard"), "rank long, shard long, quota long")
    won = by_shard.join(cells.select("rank", "shard", "here"), ["rank", "shard"])
    if carry:
        dealt = in_shards(text_rows(docs, *lean, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")))
    carried = ["_row"] if carry else []
    names_out = [*_OUT, *carried]

    def pick(batches):
        # A shard's quota comes as a row before its documents: no join has to bring it to them.
        for table in runs(batches, 2):
            key = [table.column(k)[0].as_py() for k in range(2)]
            quota, here, first = (table.column(c)[0].as_py() for c in ("quota", "here", "doc"))
            table = table.slice(1)
            sizes = table.column("size").to_numpy()
            if first or int(sizes.sum()) != here:
                raise AssertionError("a shard came in parts")
            whole, taken, parts = _picked(sizes, quota, block, seed, key[1] * 131 + key[0])
            out = {"passes": pa.array(whole, pa.int64()), "parts": pa.array([[{"begin": a, "end": b} for a, b in p] for p in parts], _PARTS), "taken": pa.array(taken, pa.int64())}
            for name, column in out.items():
                table = table.append_column(name, column)
            yield from table.select(names_out).combine_chunks().to_batches()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = dealt.select("rank", "shard", F.lit(1).alias("doc"), F.xxhash64(F.lit(seed + 1), "doc_id", "tie").alias("order"), "doc_id", "size", "source", "source_size", "target", F.lit(None).cast("long").alias("quota"), F.lit(None).cast("long").alias("here"), *carried)
    none = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in held.schema}
    quotas = won.select(*(F.col(c) if c in ("rank", "shard", "quota", "here") else F.lit(0).alias(c) if c == "doc" else none[c] for c in held.columns))
    ordered = held.unionByName(quotas).repartition(n, "rank", "shard").sortWithinPartitions("rank", "shard", "doc", "order", "doc_id", "size")
    kinds = "doc_id long, source string, size long, source_size long, target double, shard long, passes long, parts array<struct<begin:long,end:long>>, taken long"
    return ordered.mapInArrow(pick, StructType([*StructType.fromDDL(kinds), *(held.schema[c] for c in carried)]))


def mixed_documents(docs: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """The mix itself, with the columns of docs: a document's row once for each pass, and once more for each word range taken besides, cut to it. Rows carry themselves, so ids may be null or repeat."""
    mix = mix_sources(docs, text_col=text_col, carry=True, **how).where("taken > 0")
    # Words once for each document, however many ranges it has; behind a fence, or the lambda below
    # would find them again for each range.
    words = F.when(F.size("parts") > 0, F.regexp_extract_all(F.col("_row").getField(text_col).cast("string"), F.lit(WORD + SPACE_RUN.replace("+", "*")), F.lit(0)))
    rows = fenced(mix.select("_row", "passes", "parts", words.alias("_words")))
    whole = F.transform(F.sequence(F.lit(1), F.greatest(F.col("passes"), F.lit(1)).cast("int")), lambda _: F.lit(None).cast("string"))
    cut = F.transform("parts", lambda p: F.array_join(F.slice("_words", p["begin"].cast("int") + 1, (p["end"] - p["begin"]).cast("int")), ""))
    copies = F.concat(F.when(F.col("passes") > 0, whole).otherwise(F.array().cast("array<string>")), F.coalesce(cut, F.array().cast("array<string>")))
    out = rows.select("_row", F.explode(copies).alias("_copy"))
    return out.select(*(F.coalesce(F.col("_copy"), F.col("_row").getField(c)).alias(c) if c == text_col else F.col("_row").getField(c).alias(c) for c in docs.columns))
