"""Secret scans with corpus-wide ownership frequency.

One pass over the texts finds, by pattern, what is a secret wherever it stands (the base), and
candidates: strings of key-like shape, with or without a giveaway before them. Only hashes of
candidates leave the pass. Each hash is counted by distinct repositories and owners over the whole
corpus: one that many owners share is an example copied from documentation; one that few owners
have and that looks live is a credential, and all its places become spans, those that no pattern
names included.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import staged, text_rows

# The base patterns; letters in the names of `assign` in either case, ASCII only.
ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile("AKIA[A-Z0-9]+")
#: Runs are maximal, so asking for 16 at once is the same as dropping shorter matches.
HEX = re.compile("[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "owned")
#: Candidates: runs of key characters of this length or more; `=` parts a name from its value.
RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}")
_DIGIT = re.compile("[0-9]")
_PLACEHOLDER = re.compile("example|sample|placeholder|changeme|dummy|your[_-]|xxxx|1234567|abcdef", re.IGNORECASE)


def looks_live(text: str) -> bool:
    """Whether a key-like string could be a credential in use: mixed, of high entropy, no placeholder."""
    n = len(text)
    bits = -sum(c / n * math.log2(c / n) for c in map(text.count, set(text)))
    return bool(_DIGIT.search(text)) and not text.isdigit() and bits >= min(3.0, 0.75 * math.log2(n)) and not _PLACEHOLDER.search(text)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end) of each base match that passes, by start, then kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _found(texts: pa.Array) -> list[tuple]:
    out = []
    for value in texts:
        text = value.as_py() or ""
        spans = base_spans(text)
        owned = [(m.start(), m.end(), xxhash.xxh3_64_intdigest(m[0]) - (1 << 63)) for m in RUN.finditer(text) if looks_live(m[0])]
        counts = [sum(k == j for _, k, _ in spans) for j in range(3)]
        out.append((*counts, [{"start": a, "kind": k, "end": b} for a, k, b in spans], [{"start": a, "end": b, "hash": h} for a, b, h in owned]))
    return out


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
_OWNED = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("hash", pa.int64())]))


def secret_scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner: Column | str = "source", repository: Column | str | None = None, most_owners: int = 2, most_repositories: int = 6
) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_spans and spans (arrays of start, kind, end; code points, end exclusive), judged (start, end, n_owners, n_repositories and specific of each candidate place, those inside base spans too), n_owned, n_owner_specific, n_widely_copied, h0 and h1 (128 bits of the text).

    A candidate hash that at most `most_owners` owners and `most_repositories` repositories have is
    owner-specific: its places not inside a base span become spans of kind `owned`. One beyond
    either is widely copied: its places count in n_widely_copied and nothing is added; base spans
    stay in any case. A null owner is one owner. `repository` is the owner where none is given.

    Rows come out one for one. Null and empty texts have no spans; repeated rows count once in
    ownership, repeated and null ids keep their rows. An empty table gives an empty result. Columns
    of any other name are not read. Candidates are staged without their texts; a hash that a third
    of all rows have is summed within tasks before it is shuffled, and adaptive execution can split
    its join. Nothing is broadcast.
    """
    as_col = lambda x: F.col(x) if isinstance(x, str) else x
    who = F.coalesce(as_col(owner).cast("string"), F.lit("\0"))
    where = who if repository is None else F.coalesce(as_col(repository).cast("string"), F.lit("\0"))
    rows = text_rows(docs, F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(who).alias("owner"), F.xxhash64(who, where).alias("repository"), F.col(text_col).cast("string").alias("text"), *(x.alias(f"h{k}") for k, x in enumerate(_text_hashes(F.col(text_col)))))

    def scan(batches):
        for batch in batches:
            found = _found(batch.column(3))
            columns = list(zip(*found, strict=True)) or [[]] * 5
            arrays = [pa.array(columns[k], pa.int64()) for k in range(3)] + [pa.array(columns[3], _SPANS), pa.array(columns[4], _OWNED)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in (0, 1, 2, 4, 5)), *arrays], names=["doc_id", "owner", "repository", "h0", "h1", "n_assign", "n_access", "n_hex", "base_spans", "candidates"])

    schema = "doc_id long, owner long, repository long, h0 long, h1 long, n_assign long, n_access long, n_hex long, base_spans array<struct<start:int,kind:int,end:int>>, candidates array<struct<start:int,end:int,hash:long>>"
    # A row's own number: ids may repeat.
    found = staged(rows.mapInArrow(scan, schema).withColumn("row", F.monotonically_increasing_id()), "secrets")
    hashes = found.select("owner", "repository", F.explode(F.array_distinct(F.transform("candidates", lambda x: x["hash"]))).alias("hash"))
    # Staged, so that the join deals out both sides anew and a hash of most rows can be split.
    frequency = staged(ownership(hashes).select("hash", "n_owners", "n_repositories"), "ownership")
    places = found.where(F.size("candidates") > 0).select("row", F.explode("candidates").alias("c")).select("row", "c.*")
    judged = (
        places.join(frequency.hint("merge"), "hash")
        .withColumn("specific", (F.col("n_owners") <= most_owners) & (F.col("n_repositories") <= most_repositories))
        .groupBy("row")
        .agg(F.sort_array(F.collect_list(F.struct("start", "end", "n_owners", "n_repositories", "specific"))).alias("judged"))
    )
    inside = lambda x: F.exists("base_spans", lambda b: (b["start"] <= x["start"]) & (x["end"] <= b["end"]))
    judged_of = F.coalesce("judged", F.array().cast(judged.schema["judged"].dataType))
    joined = found.join(judged.hint("merge"), "row", "left").withColumn("judged", judged_of)
    joined = joined.withColumn("added", F.transform(F.filter("judged", lambda x: x["specific"] & ~inside(x)), lambda x: F.struct(x["start"].alias("start"), F.lit(3).alias("kind"), x["end"].alias("end"))))
    specific = F.size(F.filter("judged", lambda x: x["specific"])).cast("long")
    return joined.select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_spans", F.sort_array(F.concat("base_spans", "added")).alias("spans"), "judged",
        F.size("added").cast("long").alias("n_owned"), specific.alias("n_owner_specific"), (F.size("judged") - specific).alias("n_widely_copied"), "h0", "h1",
    )


def joined_verdicts(judged: Column) -> Column:
    """start:end:owners:repositories:verdict of each candidate place, comma-joined."""
    verdict = lambda x: F.when(x["specific"], "owner").otherwise("copied")
    return F.array_join(F.transform(judged, lambda x: F.concat_ws(":", *(x[c].cast("string") for c in ("start", "end", "n_owners", "n_repositories")), verdict(x))), ",")


def _text_hashes(text: Column) -> tuple[Column, Column]:
    return F.xxhash64(text.cast("string")), F.xxhash64(F.lit(1), text.cast("string"))


def ownership(hashes: DataFrame) -> DataFrame:
    """hash, n_rows, n_owners, n_repositories of rows of owner, repository, hash: first by all three, within tasks and then across, then by hash."""
    each = hashes.groupBy("hash", "owner", "repository").agg(F.count("*").alias("n"))
    by_owner = each.groupBy("hash", "owner").agg(F.sum("n").alias("n"), F.count("*").alias("r"))
    return by_owner.groupBy("hash").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_owners"), F.sum("r").alias("n_repositories"))


def joined_spans(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(docs: DataFrame, scanned: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of `scanned` replaced by `mark`, overlapping spans as one, in one pass over a text; columns and their order stay.

    Spans follow from a text alone once ownership is known, so they find their texts by 128 bits of
    them: ids may be null or repeat, and rows of one text are masked alike.
    """

    @F.arrow_udf("string")
    def masked(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([None if t is None else _masked(t, s or (), mark) for t, s in zip(texts.to_pylist(), spans.to_pylist(), strict=True)], pa.string())

    spans = scanned.where(F.size("spans") > 0).groupBy("h0", "h1").agg(F.any_value(F.transform("spans", lambda x: F.array(x["start"], x["end"]))).alias("_spans"))
    text = F.col(f"`{text_col}`")
    held = text_rows(docs, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), text.cast("string").alias("_text"), *(x.alias(f"h{k}") for k, x in enumerate(_text_hashes(text))))
    # Texts without spans stay where they are.
    joined = held.join(spans.hint("merge"), ["h0", "h1"], "left").withColumn("_done", masked(F.when(F.col("_spans").isNotNull(), F.col("_text")), F.col("_spans")))
    field = F.col("_row").getField
    return joined.select(*(F.when(F.col("_spans").isNull(), field(c)).otherwise(F.col("_done")).alias(c) if c == text_col else field(c).alias(c) for c in docs.columns))


def _masked(text: str, spans: list[list[int]], mark: str) -> str:
    out, at = [], 0
    for start, end in spans:  # by start
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def digest(spans: Column) -> Column:
    """Lowercase hex SHA-256 of the joined spans."""
    return F.sha2(joined_spans(spans), 256)


def base_digest(text: str) -> str:
    """The digest of a text's base spans, by the plain path; for tests."""
    return hashlib.sha256(_joined(base_spans(text)).encode()).hexdigest()
