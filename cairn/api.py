"""One call for each job: scan, backup, inspect, verify, preview, restore, and one snapshot of an automatic run."""

from __future__ import annotations

import hashlib
import os
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions.codecs import PIECE
from .functions.scalars import entry_type_name
from .operators.catalog import fold_hardlinks, listed
from .operators.restore import conflicts
from .operators.validate import check_automatic
from .options import check_algorithms
from .sources import archive as A, register
from .sources.datasource import SCHEMA, TreeReader, tree_state
from .sources.extract import Restored, extract
from .streaming.coalesce import watch as repeated


@dataclass(frozen=True)
class Result:
    entry_count: int
    input_bytes: int
    output_bytes: int


def scan(spark: SparkSession, source: str, includes: list[str] | None = None, content: bool = False) -> DataFrame:
    """Entries of a directory; includes: normalized paths below it."""
    register(spark)
    return spark.read.format("tree").option("includes", "\n".join(includes or [])).option("content", str(content).lower()).load(source)


def _entries(source: str, includes: list[str]) -> tuple[list[A.Entry], dict[str, tuple[int, int, int]]]:
    """A tree's entries in archive order, hard links folded: the first path keeps the content; and of each file its device, inode and time, which must still be so when it is read."""
    reader = TreeReader({"path": source, "includes": "\n".join(includes)})
    rows = [row for part in reader.partitions() for row in reader.read(part)]
    rows = [rows[0], *sorted(rows[1:], key=lambda r: os.fsencode(r[0]))]
    base, found = rows[0][0], {r[0] for r in rows}
    if lost := [x for x in includes if f"{base}/{x}" not in found]:
        raise ValueError(f"selected path is not there: {lost[0]}")
    first: dict[tuple, A.Entry] = {}
    out, states = [], {}
    for path, kind, mode, uid, gid, size, atime, mtime, ctime, target, device, dev, inode, _ in rows:
        e = A.Entry(path, kind, mode, uid, gid, size, atime, mtime, ctime, target, device)
        if kind == 1:
            states[path] = (dev, inode, mtime[0] * 1_000_000_000 + mtime[1])
            f = first.setdefault((dev, inode), e)
            if f is not e:
                if (f.mode, f.uid, f.gid, f.size, f.mtime) != (mode, uid, gid, size, mtime):
                    raise ValueError(f"hard link changed while it was read: {path}")
                e = A.Entry(path, 8, mode, uid, gid, 0, f.atime, mtime, ctime, f.path, device)
        out.append(e)
    return out, states


def _content(source: str, states: dict[str, tuple[int, int, int]]) -> A.Content:
    above = os.path.dirname(os.path.realpath(source))

    def pieces(e: A.Entry) -> Iterator[bytes]:
        fd = os.open(os.path.join(above, e.path), os.O_RDONLY | os.O_NOFOLLOW | os.O_NONBLOCK)
        with os.fdopen(fd, "rb", buffering=0) as f:
            for _ in range(2):  # before and after
                s = os.fstat(fd)
                if (s.st_dev, s.st_ino, s.st_mtime_ns) != states[e.path] or s.st_size != e.size:
                    raise ValueError(f"changed while it was read: {e.path}")
                while piece := f.read(PIECE):
                    yield piece

    return pieces


def backup(source: str, archive: str, pack: str = "index", compression: str = "none", encryption: str = "none", password: str = "", includes: list[str] | None = None, progress: A.Progress | None = None) -> Result:
    """An archive of a directory; never inside it, never over an existing file. What progress raises (A.Cancelled) stops it and leaves nothing."""
    top, out = os.path.realpath(source), os.path.realpath(archive)
    if out == top or out.startswith(top + os.sep):
        raise ValueError("the archive lies inside the source")
    if os.path.lexists(out):
        raise FileExistsError(out)
    check_algorithms(pack, compression, encryption, password)
    entries, states = _entries(source, includes or [])
    A.check_tree(entries)
    staged = f"{out}.{uuid.uuid4().hex}.part"
    try:
        with open(os.open(staged, os.O_RDWR | os.O_CREAT | os.O_EXCL, 0o600), "w+b") as f:
            n = A.write_archive(f, entries, pack, compression, encryption, password, os.urandom(16) if encryption != "none" else bytes(16), _content(source, states), progress)
            os.fsync(f.fileno())
        os.link(staged, out)
    finally:
        if os.path.exists(staged):
            os.unlink(staged)
    return Result(len(entries), sum(e.size for e in entries if e.type_id == 1), n)


def inspect(archive: str) -> A.Header:
    """Header and encoded checksum only; needs no password and authenticates nothing."""
    with open(archive, "rb") as f:
        return A.encoded_payload(f, authenticate=False)


def verify(archive: str, password: str = "", allow_legacy_encryption: bool = False, progress: A.Progress | None = None) -> Result:
    """Every check of a restore without writing."""
    with open(archive, "rb") as f, A.open_archive(f, password, allow_legacy_encryption, progress=progress) as a:
        return Result(len(a.entries), sum(e.size for e in a.entries if e.type_id == 1), 0)


def preview(spark: SparkSession, archive: str, destination: str, password: str = "") -> tuple[DataFrame, DataFrame]:
    """An archive's entries, and those whose path the destination has already."""
    with open(archive, "rb") as f, A.open_archive(f, password) as a:
        entries = a.entries
    rows = [(e.path, e.type_id, e.mode, e.uid, e.gid, e.size, e.atime, e.mtime, e.ctime, e.link_target, e.device, 0, 0, None) for e in entries]
    listed = spark.createDataFrame(rows, SCHEMA).selectExpr("path", "CASE WHEN type_id = 2 THEN 'directory' ELSE 'file' END AS type", "size")
    base, top = os.path.realpath(destination), entries[0].path
    there = [(os.path.relpath(os.path.join(d, x), base),) for d, folders, files in os.walk(os.path.join(base, top)) for x in (*folders, *files)]
    return listed, conflicts(listed, spark.createDataFrame(there, "path string"))


def restore(archive: str, destination: str, password: str = "", overwrite: bool = False, allow_legacy_encryption: bool = False, progress: A.Progress | None = None) -> Restored:
    """Extract what one decode has checked. The work file lies at the destination; a failure says how many entries were restored before it."""
    with open(archive, "rb") as f, A.open_archive(f, password, allow_legacy_encryption, destination) as a:
        return extract(a.entries, destination, overwrite, a.content, progress)


def listing(spark: SparkSession, source: str) -> DataFrame:
    """path (without the top directory), type, size, mode, uid, gid of what a directory holds; further names of a file are shown as files of its size."""
    rows = scan(spark, source)
    top = os.path.basename(os.path.realpath(source))
    folded = fold_hardlinks(rows.select("path", entry_type_name("type_id").alias("type"), "dev", "inode", "mode", "uid", "gid", "size", "atime", "mtime"))
    shown = listed(folded).where(F.col("path") != top)
    return shown.select(F.substring("path", len(top) + 2, 1 << 20).alias("path"), "type", "size", "mode", "uid", "gid")


def watch(source: str, folder: str, keep: int, interval_ms: int, wait: Callable[[float], bool], realtime: bool = False, most: int = 0, **how) -> int:
    """Snapshots, at once and then every `interval_ms`, or where `realtime` is set once something has changed when that time is over; how many were made. wait(seconds) returns whether to stop."""
    check_automatic(keep, interval_ms, os.path.realpath(source), os.path.realpath(folder))
    last = tree_state(source) if realtime else None

    def until_changed(seconds: float) -> bool:
        nonlocal last
        while not wait(seconds):
            if not realtime:
                return False
            before, last = last, tree_state(source)
            if before != last:
                return False
        return True

    return repeated(lambda: snapshot(source, folder, keep, **how), until_changed, interval_ms / 1000, most)


def snapshot(source: str, folder: str, keep: int, **how) -> str:
    """One run of an automatic job: an archive named by source and time, then the oldest of this source beyond `keep` go; other files stay."""
    prefix = f"auto-{hashlib.sha256(os.path.realpath(source).encode()).hexdigest()[:16]}-"
    name = f"{prefix}{time.time_ns() // 1000:020d}-{uuid.uuid4().hex[:16]}.bak"
    backup(source, os.path.join(folder, name), **how)
    own = sorted(x for x in os.listdir(folder) if x.startswith(prefix) and len(x) == len(name) and x.endswith(".bak"))
    for x in own[: max(0, len(own) - keep)]:
        os.unlink(os.path.join(folder, x))
    return name
