"""Data sources `tree` (a directory's entries) and `archive` (entries of archive files; also a sink)."""

from __future__ import annotations

import datetime
import glob
import hashlib
import os
import stat
import tempfile
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

from . import archive as A

SCHEMA = "path string, type_id int, mode int, uid long, gid long, size long, atime struct<sec:long,nsec:int>, mtime struct<sec:long,nsec:int>, ctime struct<sec:long,nsec:int>, link_target string, device long, dev long, inode long, content binary"
_KINDS = ((stat.S_ISREG, 1), (stat.S_ISDIR, 2), (stat.S_ISLNK, 3), (stat.S_ISFIFO, 4), (stat.S_ISCHR, 5), (stat.S_ISBLK, 6), (stat.S_ISSOCK, 7))


def _yes(options, name: str) -> bool:
    return str(options.get(name, "false")).lower() == "true"


def _row(full: str, path: str, content: bool) -> tuple:
    s = os.lstat(full)
    kind = next((k for test, k in _KINDS if test(s.st_mode)), None)
    if kind is None:
        raise ValueError(f"unsupported file type: {path}")
    time = lambda ns: (ns // 1_000_000_000, ns % 1_000_000_000)
    raw = None
    if content and kind == 1:
        fd = os.open(full, os.O_RDONLY | os.O_NOFOLLOW | os.O_NONBLOCK)
        with os.fdopen(fd, "rb") as f:
            raw = f.read()
        after = os.lstat(full)
        if (after.st_size, after.st_dev, after.st_ino, after.st_mtime_ns) != (s.st_size, s.st_dev, s.st_ino, s.st_mtime_ns):
            raise ValueError(f"changed while it was read: {path}")
    target = os.readlink(full) if kind == 3 else ""
    device = s.st_rdev if kind in (5, 6) else 0
    return (path, kind, stat.S_IMODE(s.st_mode), s.st_uid, s.st_gid, s.st_size if kind == 1 else 0, time(s.st_atime_ns), time(s.st_mtime_ns), time(s.st_ctime_ns), target, device, s.st_dev, s.st_ino, raw)


@dataclass
class _Part(InputPartition):
    top: str
    whole: bool


class TreeReader(DataSourceReader):
    """A partition for each top-level entry; `includes` (newline-separated, normalized) prunes what need not be walked."""

    def __init__(self, options):
        self.root = os.path.realpath(options["path"])
        self.content = _yes(options, "content")
        self.includes = [x for x in options.get("includes", "").split("\n") if x]
        if not os.path.isdir(self.root):
            raise ValueError(f"not a directory: {self.root}")

    def _wanted(self, path: str) -> tuple[bool, bool]:
        """Whether an entry is part of the selection, and whether anything below it can be."""
        if not self.includes:
            return True, True
        inside = any(path == x or path.startswith(x + "/") for x in self.includes)
        above = any(x.startswith(path + "/") for x in self.includes)
        return inside or above, inside or above

    def partitions(self):
        return [_Part("", False), *(_Part(name, True) for name in sorted(os.listdir(os.fsencode(self.root))) if self._wanted(os.fsdecode(name))[0])]

    def read(self, partition) -> Iterator[tuple]:
        base = os.path.basename(self.root)
        if not partition.whole:
            yield _row(self.root, base, self.content)
            return
        stack = [os.fsdecode(partition.top)]
        while stack:
            rel = stack.pop()
            if not self._wanted(rel)[0]:
                continue
            full = os.path.join(self.root, rel)
            yield _row(full, f"{base}/{rel}", self.content)
            if os.path.isdir(full) and not os.path.islink(full):
                stack += [f"{rel}/{x}" for x in sorted(os.listdir(full), reverse=True)]


class TreeSource(DataSource):
    """spark.read.format("tree").option("content", "true").load(directory): every entry, dot names included."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return TreeReader(self.options)


def _times(t) -> tuple[int, int]:
    return (t[0], t[1])


@dataclass
class _Range(InputPartition):
    """Entries first to before last of an archive; `check`: whether this one looks at the whole archive first."""

    path: str
    first: int
    last: int | None
    check: bool


class ArchiveReader(DataSourceReader):
    """Partitions of archive files; the path may be a pattern.

    Of an archive with a directory at its end and neither compression nor encryption, ranges of
    entries are partitions of about `splitBytes` of content; the first one checks the digest of the
    whole, so a damaged archive fails the job. Any other archive is one partition.
    """

    def __init__(self, options):
        self.paths = sorted(glob.glob(options["path"]))
        self.password = options.get("password", "")
        self.legacy, self.content = _yes(options, "allowLegacyEncryption"), str(options.get("content", "true")).lower() == "true"
        self.split = int(options.get("splitBytes", 128 << 20))
        if not self.paths:
            raise ValueError("no archive at the path")

    @staticmethod
    def _directory(f, total: int) -> tuple[A.Header, list[A.Entry]]:
        h = A.read_header(f.read(A.HEADER.size), total)
        return h, A.unpacked_entries(f, A.HEADER.size, h.packed_size, h.pack) if h.pack == "index" and h.compression == h.encryption == "none" else []

    def partitions(self):
        out = []
        for path in self.paths:
            ranges = [(0, None)]
            if self.content and os.path.getsize(path) > self.split:
                with open(path, "rb") as f:
                    entries, edges, held = self._directory(f, os.path.getsize(path))[1], [0], 0
                for k, e in enumerate(entries):
                    held += e.size
                    if held >= self.split and k + 1 < len(entries):
                        edges.append(k + 1)
                        held = 0
                ranges = list(zip(edges, [*edges[1:], None]))
            out += [_Range(path, a, z, k == 0) for k, (a, z) in enumerate(ranges)]
        return out

    def read(self, partition) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            if partition.check:
                opened = A.open_archive(f, self.password, self.legacy)
            else:
                opened = A.Opened(*self._directory(f, os.path.getsize(partition.path)), f, None)
            with opened as a:
                for e in a.entries[partition.first : partition.last]:
                    yield (e.path, e.type_id, e.mode, e.uid, e.gid, e.size, e.atime, e.mtime, e.ctime, e.link_target, e.device, 0, 0, b"".join(a.content(e)) if self.content and e.type_id == 1 else None)


@dataclass
class _Written(WriterCommitMessage):
    path: str
    count: int


class ArchiveWriter(DataSourceWriter):
    """Each task writes its rows, the top directory first and then by path, as one staged archive beside the target, which all executors and the driver must share; commit publishes them without replacing anything.

    Contents wait in a work file of the task until their order is known; in memory are records alone.
    """

    def __init__(self, options):
        self.path, self.options = options["path"], dict(options)

    def write(self, iterator):
        entries: list[A.Entry] = []
        with tempfile.TemporaryFile() as work:
            for r in iterator:
                raw = bytes(r.content or b"")
                entries.append(A.Entry(r.path, r.type_id, r.mode, r.uid, r.gid, r.size, _times(r.atime), _times(r.mtime), _times(r.ctime), r.link_target, r.device, at=work.tell()))
                work.write(raw)
            if not entries:
                return _Written("", 0)
            top = min(entries, key=lambda e: e.path.count("/"))
            entries = [top, *sorted((e for e in entries if e is not top), key=lambda e: e.path.encode("utf-8", "surrogateescape"))]
            A.check_tree(entries)
            password, encryption = self.options.get("password", ""), self.options.get("encryption", "none")
            staged = f"{self.path}.{uuid.uuid4().hex}.part"
            held = A.Opened(None, entries, work, None)
            try:
                with open(os.open(staged, os.O_RDWR | os.O_CREAT | os.O_EXCL, 0o600), "w+b") as f:
                    A.write_archive(f, entries, self.options.get("pack", "index"), self.options.get("compression", "none"), encryption, password, os.urandom(16) if encryption != "none" else bytes(16), held.content)
                    os.fsync(f.fileno())
            except BaseException:
                if os.path.exists(staged):
                    os.unlink(staged)
                raise
        return _Written(staged, len(entries))

    def commit(self, messages):
        made = [m for m in messages if m is not None and m.count]
        for k, m in enumerate(made):
            os.link(m.path, self.path if len(made) == 1 else f"{self.path}.{k:05d}")  # fails where the target exists
            os.unlink(m.path)

    def abort(self, messages):
        for m in messages:
            if m is not None and m.path and os.path.exists(m.path):
                os.unlink(m.path)


class ArchiveSource(DataSource):
    """spark.read.format("archive").option("password", ...).load(path); df.coalesce(1).write.format("archive").mode("append").save(path)."""

    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return ArchiveReader(self.options)

    def writer(self, schema, overwrite):
        return ArchiveWriter(self.options)


def tree_state(root: str) -> str:
    """A digest of what a tree's entries are: another one after any change. For a watch on the machine that has the tree."""
    digest = hashlib.sha256()
    for folder, folders, files in os.walk(root):
        folders.sort()
        for name in sorted((*folders, *files)):
            try:
                s = os.lstat(os.path.join(folder, name))
            except FileNotFoundError:
                continue
            digest.update(f"{folder}\0{name}\0{s.st_mode}\0{s.st_size}\0{s.st_ino}\0{s.st_mtime_ns}\0{s.st_ctime_ns}\n".encode("utf-8", "surrogateescape"))
    return digest.hexdigest()


@dataclass
class _Changed(InputPartition):
    top: str
    whole: bool
    start: int
    end: int


class ChangeReader(DataSourceStreamReader):
    """A row for each part of a tree that has changed between two times; which entry changed is not told.

    Any change of an entry sets its change time, and that of its folder where it comes or goes. So
    offsets are times, a task for each top-level entry looks for change times between two of them,
    and neither the driver nor a checkpoint holds anything of the tree. What happens while no query
    runs is found when it goes on. A second is read once LAG_NS have passed, as clocks of files lag.
    """

    LAG_NS = SECOND_NS = 1_000_000_000

    def __init__(self, options):
        self.root, self.first = os.path.realpath(options["path"]), time.time_ns()

    def initialOffset(self) -> dict:
        return {"ns": self.first}

    def latestOffset(self) -> dict:
        return {"ns": max(self.first, (time.time_ns() - self.LAG_NS) // self.SECOND_NS * self.SECOND_NS)}

    def partitions(self, start: dict, end: dict):
        if start["ns"] >= end["ns"]:
            return []
        tops = [("", False), *((os.fsdecode(x), True) for x in sorted(os.listdir(os.fsencode(self.root))))]
        return [_Changed(top, whole, start["ns"], end["ns"]) for top, whole in tops]

    def read(self, partition) -> Iterator[tuple]:
        def changed(path: str) -> bool:
            try:
                return partition.start < os.lstat(path).st_ctime_ns <= partition.end
            except FileNotFoundError:
                return False  # its folder has changed then

        top = os.path.join(self.root, partition.top) if partition.whole else self.root
        found = changed(top)
        if partition.whole and not found and os.path.isdir(top) and not os.path.islink(top):
            found = any(changed(os.path.join(folder, name)) for folder, folders, files in os.walk(top) for name in (*folders, *files))
        if found:
            yield self.root, datetime.datetime.fromtimestamp(partition.end / 1e9, datetime.timezone.utc)


class ChangeSource(DataSource):
    """spark.readStream.format("tree_changes").load(directory): source, ts of changes; feeds streaming.coalesce.stream_triggers."""

    @classmethod
    def name(cls) -> str:
        return "tree_changes"

    def schema(self) -> str:
        return "source string, ts timestamp"

    def streamReader(self, schema):
        return ChangeReader(self.options)
