"""Connected components of an edge table: of few edges in one task, of more by large-star and small-star rounds; nothing but counts reaches the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import discard, staged

#: Rows of a large group, about, that all its blocks are compared with first.
HUBS = 4
#: Edges that one task joins up by itself (16 bytes each): a round over fewer is all start-up of tasks.
FEW_EDGES = 1 << 20


def components(edges: DataFrame, most_rounds: int = 64, few: int = FEW_EDGES) -> DataFrame:
    """id, component (the smallest id reachable) of every id in edges (a, b: long).

    Up to `few` edges are one task's; more go through rounds. Each round points all larger neighbours of a node, then all smaller ones, at the smallest known;
    the result is a star for each component. Degrees are summed within tasks before they are
    shuffled, and the joins back are split at run time where one node has most edges.
    """
    # Least neighbours are dealt out at random before they are joined back: the join then deals out
    # both sides by itself, and a node with most of the edges can be split.
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    given = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "edges")
    if given.count() <= few:
        out = staged(given.coalesce(1).mapInArrow(_united, "id long, component long"), "components")
        discard(given)
        return out
    now = staged(given.distinct(), "edges")
    discard(given)
    seen = _print(now)
    for _ in range(most_rounds):
        if not seen[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u")).repartition(n)
        large = both.where("v > u").join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).repartition(n)
        small = large.join(low.hint("merge"), "u").select("u", "v", "m")
        turned = small.select(F.explode(F.array(F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        before, now = now, staged(turned, "edges")
        discard(before)
        if (then := _print(now)) == seen:
            break
        seen = then
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _united(batches):
    """id, component of all edges u, v at once: roots are hooked to the smallest root beside them until none are left to hook."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not held:
        return
    ids, place = np.unique(np.concatenate([*(u for u, _ in held), *(v for _, v in held)]), return_inverse=True)
    a, b = place.reshape(2, -1)
    root = np.arange(len(ids))
    while len(a):
        x, y = root[a], root[b]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(over := root[root], root):
            root = over
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    for k in range(0, len(ids), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(ids[k : k + (1 << 16)]), pa.array(ids[root[k : k + (1 << 16)]])], names=["id", "component"])


def _print(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.bit_xor(F.xxhash64("v", "u", F.lit(1))).alias("y")).first()
    return row.n, row.x, row.y


def _hubbed(members: DataFrame, size: str, member: str, most: int) -> DataFrame:
    """members with i and j: groups of at most `most` rows stay whole (0, 0); of larger ones each row goes to one block of about most / 2, and a few hubs, about HUBS in a group, to all."""
    n = F.ceil(F.col(size) * 2 / F.lit(most)).cast("int")
    own, hub = F.pmod(F.xxhash64(F.lit(11), member), n).cast("int"), F.pmod(F.xxhash64(F.lit(13), member), F.greatest(F.lit(1), F.floor(F.col(size) / HUBS))) == 0
    places = F.when(F.col(size) <= most, F.array(F.lit(0))).when(hub, F.sequence(F.lit(0), n - 1)).otherwise(F.array(own))
    return members.select("*", F.explode(places).alias("i"), F.lit(0).alias("j"))


def _apart(members: DataFrame, size: str, member: str, most: int) -> DataFrame:
    """members (with `main` and `rest`, how many rows of the group are not main) with i and j: each row that is not main meets every row of its group."""
    n, m = F.ceil(F.col(size) * 2 / F.lit(most)).cast("int"), F.greatest(F.lit(1), F.ceil(F.col("rest") * 2 / F.lit(most))).cast("int")
    pair = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    mine, own = F.col("_mine"), F.col("_own")
    beside = F.transform(F.sequence(F.lit(0), m - 1), lambda r: pair(mine, r))
    among = F.when(m == 1, F.array(pair(n, F.lit(0)))).otherwise(F.transform(F.filter(F.sequence(F.lit(0), m - 1), lambda r: r != own), lambda r: pair(n + F.least(r, own), F.greatest(r, own))))
    across = F.concat(F.transform(F.sequence(F.lit(0), n - 1), lambda k: pair(k, own)), among)
    dealt = members.withColumn("_mine", F.pmod(F.xxhash64(F.lit(11), member), n).cast("int")).withColumn("_own", F.pmod(F.xxhash64(F.lit(12), member), m).cast("int"))
    return dealt.withColumn("_pair", F.explode(F.when(F.col("main"), beside).otherwise(across))).select(*members.columns, "_pair.i", "_pair.j")


def linked_groups(lean: DataFrame, key: str, size: str, member: str, node: str, most: int, carried, edges, more: DataFrame | None = None) -> DataFrame:
    """id, component over all links within groups, and over `more` (a, b); lean, staged: key, size, member (unique within a group), node (what edges join).

    carried(rows) joins what the comparison needs to rows of lean; edges(rows with i and j) is a
    spanning forest of the links in each (key, i, j). Groups of up to `most` are compared whole. Of
    larger ones each row first meets its block and a few hubs; only rows that are then still apart
    from the largest part of their group meet all others. So a large group of rows that are alike
    costs what it holds, and no link is lost in one that is not.
    """
    first = edges(_hubbed(carried(lean), size, member, most))
    found = components(first if more is None else first.unionByName(more))
    large = lean.where(F.col(size) > most)
    if large.isEmpty():
        return found
    told = staged(large.join(found.select(F.col("id").alias(node), F.col("component").alias("_part")).hint("merge"), node, "left").select(*lean.columns, F.coalesce("_part", node).alias("_part")), "told")
    parts = told.groupBy(key, "_part").agg(F.count("*").alias("n"))
    apart = staged(parts.groupBy(key).agg(F.max(F.struct("n", "_part")).alias("m"), F.sum("n").alias("n")).select(key, F.col("m._part").alias("_main"), (F.col("n") - F.col("m.n")).alias("rest")).where("rest > 0"), "apart")
    if apart.isEmpty():
        return found
    left = staged(told.join(apart.hint("merge"), key).select(*lean.columns, (F.col("_part") == F.col("_main")).alias("main"), "rest"), "left")
    stars = found.where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b"))
    return components(stars.unionByName(edges(_apart(carried(left), size, member, most))))


def runs(batches, keys: int):
    """Groups of rows that agree in the first `keys` columns, as lists of columns, from batches sorted by them; a group may span batches."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        change = np.zeros(table.num_rows, bool)
        for k in range(keys):
            column = table.column(k).to_numpy(zero_copy_only=False)
            change[1:] |= column[1:] != column[:-1]
        edges = [0, *np.flatnonzero(change).tolist()]
        for a, z in zip(edges[:-1], edges[1:], strict=True):
            yield table.slice(a, z - a)
        held = table.slice(edges[-1]).combine_chunks()
    if held is not None:
        yield held


def spanning(n: int, similar) -> list[tuple[int, int]]:
    """Edges (root, member) of the components of a group; similar(x, rest) says which of the places `rest` are linked with x. Only those not yet reached are compared."""
    rest, edges = np.arange(n), []
    while len(rest) > 1:
        root, rest = int(rest[0]), rest[1:]
        queue = [root]
        while queue and len(rest):
            hit = similar(queue.pop(), rest)
            if hit.any():
                new = rest[hit].tolist()
                edges += [(root, x) for x in new]
                queue += new
                rest = rest[~hit]
    return edges
