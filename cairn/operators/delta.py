"""Positional block deltas between versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

# Bytes of a transfer block and blocks that are indexed at most.
BLOCK, MOST_BLOCKS = 512 << 10, 1 << 20


def blocks(blobs: DataFrame, size: int = BLOCK) -> DataFrame:
    """id, block_no, len, sha256, content of blobs (id, content: string or binary), cut every `size`; empty content has no block."""
    held = blobs.where(F.length("content") > 0)
    if blobs.schema["content"].dataType.typeName() == "string":
        # In one pass: finding the k-th character of a string means walking there from its start.
        parts = held.select("id", F.posexplode(F.regexp_extract_all("content", F.lit(f"(?s).{{1,{size}}}"), F.lit(0))).alias("block_no", "content"))
    else:
        n = F.ceil(F.length("content") / F.lit(size)).cast("int")
        numbered = held.select("id", "content", F.explode(F.sequence(F.lit(0), n - 1)).alias("block_no"))
        parts = numbered.select("id", "block_no", F.substr("content", F.col("block_no") * size + 1, F.lit(size)).alias("content"))
    return parts.select("id", F.col("block_no").cast("long").alias("block_no"), F.length("content").cast("long").alias("len"), F.sha2("content", 256).alias("sha256"), "content")


def range_digest(content, offset, length):
    """SHA-256 of bytes `offset` to `offset + length` of binary content; a range that is not there raises."""
    there = (offset >= 0) & (length >= 0) & (offset + length <= F.octet_length(content))
    return F.when(there, F.sha2(F.substr(content, (offset + 1).cast("int"), length.cast("int")), 256)).otherwise(F.raise_error(F.lit("range is outside the content")).cast("string"))


def choose_base(versions: DataFrame, series: str = "series", order: str = "id", encryption: str | None = None) -> DataFrame:
    """id, base: the newest earlier version of the same non-empty series; null means a full upload. Content stays out of the sort.

    encryption: a column; what is encrypted shares no blocks with any version and takes no part in deltas.
    """
    versions = versions if encryption is None else versions.where(F.col(encryption) == "none")
    lean = versions.where(F.col(series) != "").select("id", F.xxhash64(series).alias("_s"), F.col(series).alias("_n"), order if order != "id" else F.col("id").alias("_o"))
    w = W.partitionBy("_s", "_n").orderBy(lean.columns[-1])
    return lean.select("id", F.lag("id").over(w).alias("base"))


def delta(new_blocks: DataFrame, base_blocks: DataFrame, bases: DataFrame, most: int = MOST_BLOCKS) -> DataFrame:
    """id, base, block_no, len, reused, and content where it is not: block i is reused if block i of the base has its digest and length. Only the first `most` base blocks are indexed."""
    index = base_blocks.where(F.col("block_no") < most).select(F.col("id").alias("base"), "block_no", F.col("sha256").alias("_sha"), F.col("len").alias("_len"))
    joined = new_blocks.join(bases, "id", "left").join(index, ["base", "block_no"], "left")
    reused = F.coalesce((F.col("_sha") == F.col("sha256")) & (F.col("_len") == F.col("len")), F.lit(False))
    return joined.select("id", "base", "block_no", "len", reused.alias("reused"), F.when(~reused, F.col("content")).alias("content"))


def indexed_blocks(base_blocks: DataFrame, bases: DataFrame, declared: DataFrame, size: int = BLOCK, most: int = MOST_BLOCKS) -> DataFrame:
    """id, base, block_no, sha256, len: what is indexed of each version's base; declared (id, declared_size) needs no block beyond its own last one."""
    cap = F.least(F.ceil(F.col("declared_size") / F.lit(size)), F.lit(most))
    wanted = bases.where("base IS NOT NULL").join(declared.select("id", cap.alias("_cap")), "id")
    return wanted.join(base_blocks.select(F.col("id").alias("base"), "block_no", "sha256", "len"), "base").where("block_no < _cap").select("id", "base", "block_no", "sha256", "len")


def references(deltas: DataFrame, size: int = BLOCK) -> DataFrame:
    """id, place (of the block in the version), base, and either copy (offset, len in the base) or content: what goes over the wire."""
    copy = F.when(F.col("reused"), F.struct((F.col("block_no") * size).alias("offset"), F.col("len").alias("len")))
    return deltas.select("id", (F.col("block_no") * size).alias("place"), "base", copy.alias("copy"), "content")


def resolved(refs: DataFrame, base_blocks: DataFrame, size: int = BLOCK) -> DataFrame:
    """id, place, content: pieces that references stand for; a copy may begin and end inside blocks. A copy of what the base has not raises.

    Copies are cut at the base's block edges, so they are an equi-join by block, however large a base is.
    """
    kind = refs.schema["content"].dataType
    last = F.col("copy.offset") + F.col("copy.len") - 1
    first_block = F.floor(F.col("copy.offset") / size)
    each = refs.where("copy IS NOT NULL").select("id", "place", "base", "copy.*", F.explode(F.sequence(first_block, F.floor(last / size))).alias("block_no"))
    held = base_blocks.select(F.col("id").alias("base"), "block_no", F.col("content").alias("_base"), F.col("len").alias("_len"))
    low, high = F.greatest(F.col("offset") - F.col("block_no") * size, F.lit(0)), F.least(F.col("offset") + F.col("len") - F.col("block_no") * size, F.lit(size))
    lost = F.raise_error(F.concat(F.lit("missing base block of "), F.col("id").cast("string"))).cast(kind)
    part = F.when(F.col("_len") >= high, F.substr("_base", (low + 1).cast("int"), (high - low).cast("int"))).otherwise(lost)
    copied = each.join(held, ["base", "block_no"], "left").select("id", (F.col("place") + F.greatest(F.col("block_no") * size - F.col("offset"), F.lit(0))).alias("place"), part.alias("content"))
    return refs.where("copy IS NULL").select("id", "place", "content").unionByName(copied)


def reuse(deltas: DataFrame, versions: DataFrame | None = None) -> DataFrame:
    """Blocks, reused blocks and reused length of each id; of all of versions where they are given, empty ones included."""
    out = deltas.groupBy("id").agg(F.count("*").alias("n_blocks"), F.count_if("reused").alias("n_reused"), F.coalesce(F.sum(F.when(F.col("reused"), F.col("len"))), F.lit(0)).cast("long").alias("reused_len"))
    return out if versions is None else versions.select("id").join(out, "id", "left").na.fill(0, ["n_blocks", "n_reused", "reused_len"])


def apply_delta(deltas: DataFrame, base_blocks: DataFrame) -> DataFrame:
    """id, block_no, content: the version that a delta describes, whole; a reference without its block raises."""
    index = base_blocks.select(F.col("id").alias("base"), "block_no", F.col("content").alias("_base"))
    lost = F.raise_error(F.concat(F.lit("missing base block of "), F.col("id").cast("string")))
    content = F.when(~F.col("reused"), F.col("content")).when(F.col("_base").isNotNull(), F.col("_base"))
    return deltas.join(index, ["base", "block_no"], "left").select("id", "block_no", F.coalesce(content, lost.cast(deltas.schema["content"].dataType)).alias("content"))


def packed(versions: DataFrame, bases: DataFrame, size: int = BLOCK, most: int = MOST_BLOCKS) -> DataFrame:
    """id, base, pieces (place, copy, content in order): the references of each version (id, content: binary) in one row.

    No block is a row: a version meets its base whole, so the versions are dealt out once by id, and those with a base once
    more by it. Ids are keys; a base that is not there is copied from by nothing.
    """
    whole, based = _whole(versions), bases.where("id IS NOT NULL AND base IS NOT NULL").select("id", "base")
    plain = whole.join(based.hint("merge"), "id", "left_anti").select("id", F.lit(None).cast(based.schema["base"].dataType).alias("base"), _pieces(F.col("content"), None, size, most).alias("pieces"))
    mine = whole.join(based.hint("merge"), "id").select(F.col("id").alias("_id"), "base", F.col("content").alias("_own"))
    beside = mine.join(whole.hint("merge"), F.col("base") == F.col("id"), "left")
    return plain.unionByName(beside.select(F.col("_id").alias("id"), "base", _pieces(F.col("_own"), F.col("content"), size, most).alias("pieces")))


def _whole(versions: DataFrame) -> DataFrame:
    """The same columns and filter wherever versions are dealt out by id, so that it is done once."""
    return versions.select("id", "content").where("id IS NOT NULL")


def _pieces(content: Column, base: Column | None, size: int, most: int) -> Column:
    def piece(i):
        cut = lambda x: F.substr(x, (i * size + 1).cast("int"), F.lit(size))
        same = F.lit(False) if base is None else F.coalesce((i < most) & (cut(content) == cut(base)), F.lit(False))
        place = (i * size).cast("long")
        copy = F.when(same, F.struct(place.alias("offset"), F.octet_length(cut(content)).cast("long").alias("len")))
        return F.struct(place.alias("place"), copy.alias("copy"), F.when(~same, cut(content)).alias("content"))

    n = F.ceil(F.octet_length(content) / F.lit(size)).cast("int")
    # sequence(0, -1) counts down, so empty content is kept apart.
    return F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), piece)


def unpacked(rows: DataFrame, versions: DataFrame) -> DataFrame:
    """id, content: versions that packed rows stand for, with copies from the bases among versions. A copy of what a base has not raises."""
    lost = F.raise_error(F.concat(F.lit("missing base block of "), F.col("_id").cast("string"))).cast("binary")

    def joined(base):
        def part(p):
            offset, n = p["copy"]["offset"], p["copy"]["len"]
            there = (offset >= 0) & (offset + n <= F.octet_length(base))
            return F.hex(F.when(p["copy"].isNull(), p["content"]).when(there, F.substr(base, (offset + 1).cast("int"), n.cast("int"))).otherwise(lost))

        return F.unhex(F.array_join(F.transform("pieces", part), "")).alias("content")

    named = rows.select(F.col("id").alias("_id"), "base", "pieces")
    copied = named.where("base IS NOT NULL").join(_whole(versions).hint("merge"), F.col("base") == F.col("id"), "left").select("_id", joined(F.col("content")))
    return named.where("base IS NULL").select("_id", joined(F.lit(None).cast("binary"))).unionByName(copied).withColumnRenamed("_id", "id")


def held_against(rebuilt: DataFrame, declared: DataFrame) -> DataFrame:
    """id, len, sha256 of the versions declared (id, declared_size, declared_sha256), as rebuilt (id, content) has them; one that is lost or differs raises. Content is not moved."""
    got = rebuilt.select("id", F.octet_length("content").cast("long").alias("len"), F.sha2("content", 256).alias("sha256"))
    good = F.coalesce((F.col("len") == F.col("declared_size")) & (F.col("sha256") == F.col("declared_sha256")), F.lit(False))
    differs = F.raise_error(F.concat(F.lit("rebuilt version differs from its declaration: "), F.coalesce(F.col("id").cast("string"), F.lit("null"))))
    joined = declared.select("id", "declared_size", "declared_sha256").join(got.hint("merge"), "id", "left")
    return joined.select("id", F.when(good, F.col("len")).otherwise(differs.cast("long")).alias("len"), F.when(good, F.col("sha256")).otherwise(differs.cast("string")).alias("sha256"))


def assembled(parts: DataFrame, declared: DataFrame | None = None, by: str = "block_no") -> DataFrame:
    """id, content: pieces in order of `by`, strings or bytes as they are.

    declared (id, declared_size, declared_sha256): the versions that must come out, those without
    pieces as empty ones; one that has another size in bytes or another digest raises.
    """
    kind = parts.schema["content"].dataType
    ordered = F.transform(F.sort_array(F.collect_list(F.struct(by, "content"))), lambda x: x["content"])
    # Bytes by way of hex: joined in one pass, where a fold would copy what it has for every piece.
    whole = F.array_join(ordered, "") if kind.typeName() == "string" else F.unhex(F.array_join(F.transform(ordered, F.hex), ""))
    out = parts.groupBy("id").agg(whole.alias("content"))
    if declared is None:
        return out
    joined = declared.select("id", "declared_size", "declared_sha256").join(out, "id", "left").withColumn("content", F.coalesce("content", F.lit("").cast(kind)))
    good = (F.octet_length("content") == F.col("declared_size")) & (F.sha2("content", 256) == F.col("declared_sha256"))
    return joined.select("id", F.when(good, F.col("content")).otherwise(F.raise_error(F.concat(F.lit("rebuilt version differs from its declaration: "), F.col("id").cast("string"))).cast(kind)).alias("content"))


def bad_references(refs: DataFrame, size: int = BLOCK) -> DataFrame:
    """Block references (id, offset, len, base_size, declared_size) out of range, with the rule that each one breaks."""
    rules = {"length": (F.col("len") <= 0) | (F.col("len") > size), "base": F.col("offset") + F.col("len") > F.col("base_size"), "declared": F.col("offset") + F.col("len") > F.col("declared_size"), "offset": F.col("offset") < 0}
    found = F.filter(F.array(*(F.when(test, F.lit(name)) for name, test in rules.items())), lambda x: x.isNotNull())
    return refs.withColumn("rule", F.explode(found))
