"""The archive format: packing, compression, encryption and authentication of a tree's entries.

Everything is checked in one order, and nothing is used before it is: header, authentication,
digest, decryption, decompression, size, digest, records, rules across records. Filters in a query
plan may change places, so this order lives in one function and not in a plan.

Both ways go through a file a piece at a time: what is held are the entries' records and a piece of
content, however large files are. Only what is compressed or encrypted is unpacked to a work file.
"""

from __future__ import annotations

import hashlib
import hmac
import io
import os
import struct
import tempfile
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace
from typing import BinaryIO

from ..functions.ciphers import Cipher, archive_authenticator
from ..functions.codecs import PIECE, PIECES, UNPACKED, Malformed
from ..functions.scalars import COMPRESSIONS, ENCRYPTIONS, PACKINGS

# The header, a record's fixed parts, and the marks of both packings.
HEADER = struct.Struct("<4sHHIBBBBQQ16s32s32s")
MAGIC, TAG = b"BKP2", 32
RECORD = struct.Struct("<BIIIQqIqIqI")
STREAM, INDEX, DIRECTORY, TRAILER, MARK = b"STRMPK1\0", b"INDXPK1\0", b"CDIRV1\0\0", b"IDXEND1\0", 0x52544E45
MOST_ENTRIES, MOST_STRING = 1_000_000, 1 << 20
_NUMBERS = {t: {v: k for k, v in names.items()} for t, names in (("pack", PACKINGS), ("compression", COMPRESSIONS), ("encryption", ENCRYPTIONS))}


@dataclass(frozen=True)
class Entry:
    path: str
    type_id: int
    mode: int = 0o644
    uid: int = 0
    gid: int = 0
    size: int = 0
    atime: tuple[int, int] = (0, 0)
    mtime: tuple[int, int] = (0, 0)
    ctime: tuple[int, int] = (0, 0)
    link_target: str = ""
    device: int = 0
    content: bytes = field(default=b"", repr=False)
    #: Where the content begins in the packed bytes, of an entry that was read.
    at: int = field(default=0, compare=False, repr=False)


class Cancelled(RuntimeError):
    """Raised where a job was asked to stop."""


#: Called with bytes done and bytes in all; what it raises stops the job.
Progress = Callable[[int, int], None]


@dataclass(frozen=True)
class Header:
    version: int
    flags: int
    pack: str
    compression: str
    encryption: str
    packed_size: int
    encoded_size: int
    salt: bytes
    packed_digest: bytes
    encoded_digest: bytes


def _need(test: bool, what: str) -> None:
    if not test:
        raise Malformed(what)


def _string(text: str) -> bytes:
    raw = text.encode("utf-8", "surrogateescape")
    return struct.pack("<I", len(raw)) + raw


def _record(e: Entry, offset: int | None) -> bytes:
    size = e.size if e.type_id == 1 else 0
    out = _string(e.path) + RECORD.pack(e.type_id, e.mode, e.uid, e.gid, size, *e.atime, *e.mtime, *e.ctime) + _string(e.link_target) + struct.pack("<Q", e.device)
    return out if offset is None else out + struct.pack("<Q", offset)


class _Reader:
    """Records of a file from `at` to before `end`."""

    def __init__(self, file: BinaryIO, at: int, end: int):
        self.file, self.at, self.end = file, at, end
        file.seek(at)

    def take(self, n: int) -> bytes:
        _need(0 <= n <= self.end - self.at, "data ends early")
        raw = self.file.read(n)
        _need(len(raw) == n, "data ends early")
        self.at += n
        return raw

    def skip(self, n: int) -> None:
        _need(0 <= n <= self.end - self.at, "data ends early")
        self.at += n
        self.file.seek(self.at)

    def number(self, form: str) -> int:
        return struct.unpack(form, self.take(struct.calcsize(form)))[0]

    def string(self) -> str:
        n = self.number("<I")
        _need(n <= MOST_STRING, "string is too long")
        raw = self.take(n)
        _need(b"\0" not in raw, "string has a NUL")
        return raw.decode("utf-8", "surrogateescape")

    def entry(self) -> Entry:
        path = self.string()
        type_id, mode, uid, gid, size, *times = RECORD.unpack(self.take(RECORD.size))
        e = Entry(path, type_id, mode, uid, gid, size, tuple(times[:2]), tuple(times[2:4]), tuple(times[4:]), self.string(), self.number("<Q"))
        _need(1 <= type_id <= 8, "unknown entry type")
        _need(all(t[1] < 1_000_000_000 for t in (e.atime, e.mtime, e.ctime)), "nanoseconds out of range")
        _need(mode & 0o7777 == mode, "mode out of range")
        _need(type_id == 1 or size == 0, "only a file has a size")
        _need(type_id in (3, 8) or not e.link_target, "only a link has a target")
        _need(type_id in (5, 6) or not e.device, "only a device has a number")
        return e


#: Pieces of an entry's content.
Content = Callable[[Entry], Iterable[bytes]]


def own_content(e: Entry) -> Iterator[bytes]:
    for k in range(0, len(e.content), PIECE):
        yield e.content[k : k + PIECE]


def _exact(e: Entry, content: Content) -> Iterator[bytes]:
    n = 0
    for piece in content(e):
        n += len(piece)
        _need(n <= e.size, f"content has another size than its entry: {e.path}")
        yield piece
    _need(n == e.size, f"content has another size than its entry: {e.path}")


def packed_pieces(entries: list[Entry], pack: str, content: Content = own_content) -> Iterator[bytes]:
    """The packed bytes: records each followed by content, or all content and then a directory of records with offsets."""
    if pack == "stream":
        yield STREAM + struct.pack("<I", len(entries))
        for e in entries:
            yield struct.pack("<I", MARK) + _record(e, None)
            if e.type_id == 1:
                yield from _exact(e, content)
        return
    yield INDEX
    for e in entries:
        if e.type_id == 1:
            yield from _exact(e, content)
    at, length = len(INDEX), len(DIRECTORY) + 4
    yield DIRECTORY + struct.pack("<I", len(entries))
    for e in entries:
        record = _record(e, at if e.type_id == 1 else 0)
        at, length = at + (e.size if e.type_id == 1 else 0), length + len(record)
        yield record
    yield TRAILER + struct.pack("<QQII", at, length, len(entries), 0)


def packed_size(entries: list[Entry], pack: str) -> int:
    each = sum(len(_record(e, 0 if pack == "index" else None)) + (e.size if e.type_id == 1 else 0) for e in entries)
    return each + (len(STREAM) + 4 + 4 * len(entries) if pack == "stream" else len(INDEX) + len(DIRECTORY) + 4 + 32)


def unpacked_entries(file: BinaryIO, base: int, size: int, pack: str) -> list[Entry]:
    """Entries of packed bytes in a file, without their content; `at` says where in the file it begins."""
    out, end = [], base + size
    if pack == "stream":
        r = _Reader(file, base, end)
        _need(r.take(8) == STREAM, "bad stream packing")
        n = r.number("<I")
        _need(n <= MOST_ENTRIES and n <= (size - 12) // 78, "too many entries for the data")
        for _ in range(n):
            _need(r.number("<I") == MARK, "bad entry mark")
            e = r.entry()
            out.append(replace(e, at=r.at))
            r.skip(e.size)
        _need(r.at == r.end, "trailing data")
        return out
    _need(size >= 52 and _Reader(file, base, end).take(8) == INDEX, "bad index packing")
    tail = _Reader(file, end - 32, end).take(32)
    at, length, n, zero = struct.unpack("<QQII", tail[8:])
    _need(tail[:8] == TRAILER and zero == 0 and at >= 8 and at + length == size - 32, "bad index trailer")
    r = _Reader(file, base + at, base + at + length)
    _need(r.take(8) == DIRECTORY and r.number("<I") == n, "bad central directory")
    _need(n <= MOST_ENTRIES and n <= (length - 12) // 82, "too many entries for the data")
    for _ in range(n):
        e = r.entry()
        offset = r.number("<Q")
        if e.type_id == 1:
            _need(8 <= offset <= at and e.size <= at - offset, "content outside the content region")
        else:
            _need(offset == 0, "only a file has an offset")
        out.append(replace(e, at=base + offset))
    _need(r.at == r.end, "trailing data")
    return out


def check_tree(entries: list[Entry]) -> None:
    """Rules across entries, in order; the first that is broken raises."""
    _need(0 < len(entries) <= MOST_ENTRIES, "no entries or too many")
    root, seen = entries[0].path, {}
    _need(entries[0].type_id == 2 and "/" not in root, "the first entry must be the top directory")
    for e in entries:
        parts = e.path.split("/")
        _need(bool(e.path) and not any(x in ("", ".", "..") for x in parts), "unsafe path")
        _need(e.path not in seen, "duplicate path")
        _need(parts[0] == root, "entry outside the top directory")
        if e.type_id == 8:
            target = seen.get(e.link_target)
            _need(target is not None and target.type_id == 1, "alias without an earlier file")
            _need((target.mode, target.uid, target.gid, target.mtime) == (e.mode, e.uid, e.gid, e.mtime), "alias metadata differ")
        seen[e.path] = e
    for e in entries:
        parts = e.path.split("/")
        for k in range(1, len(parts)):
            up = seen.get("/".join(parts[:k]))
            _need(up is not None and up.type_id == 2, "an ancestor is missing or no directory")


def read_header(data: bytes, total: int | None = None) -> Header:
    """The header, checked; total: bytes of the archive, which must be what the header says."""
    _need(len(data) >= HEADER.size, "archive is too short")
    magic, version, size, flags, pack, compression, encryption, reserved, packed, encoded, salt, packed_digest, encoded_digest = HEADER.unpack_from(data)
    _need(magic == MAGIC, "bad magic")
    _need(1 <= version <= 4 and size == HEADER.size and reserved == 0, "unsupported header")
    _need(pack in PACKINGS and compression in COMPRESSIONS and encryption in ENCRYPTIONS, "unknown algorithm")
    _need(compression != 3 or version >= 3, "LZ77 needs version 3")
    _need(version != 4 or encryption != 0, "version 4 is for encrypted archives")
    _need(flags == (1 | 2 * (compression != 0) | 4 * (encryption != 0)), "flags do not match the algorithms")
    _need(total is None or total == HEADER.size + encoded + TAG * (version == 4), "payload size differs")
    return Header(version, flags, PACKINGS[pack], COMPRESSIONS[compression], ENCRYPTIONS[encryption], packed, encoded, salt, packed_digest, encoded_digest)


def _regions(file: BinaryIO, at: int, n: int) -> Iterator[bytes]:
    """n bytes of a file from `at` on, in pieces."""
    file.seek(at)
    while n:
        piece = file.read(min(n, PIECE))
        _need(bool(piece), "data ends early")
        n -= len(piece)
        yield piece


def write_archive(
    file: BinaryIO, entries: list[Entry], pack: str = "index", compression: str = "none", encryption: str = "none", password: str = "", salt: bytes = bytes(16), content: Content = own_content, progress: Progress | None = None
) -> int:
    """An archive of entries, the top directory first, then by path, to an empty file open both ways; its size. salt: 16 random bytes where it is encrypted."""
    cipher, size = Cipher(encryption, password, salt), packed_size(entries, pack)
    packed_digest, encoded_digest, done = hashlib.sha256(), hashlib.sha256(), 0
    passes = 0

    def make() -> Iterator[bytes]:
        nonlocal packed_digest, passes, done
        packed_digest, passes, done = hashlib.sha256(), passes + 1, 0
        # Small records go together.
        held: list[bytes] = []
        n = 0
        for piece in packed_pieces(entries, pack, content):
            held.append(piece)
            n += len(piece)
            if n >= PIECE:
                yield from joined(held)
                held, n = [], 0
        yield from joined(held)

    def joined(held: list[bytes]) -> Iterator[bytes]:
        nonlocal done
        piece = held[0] if len(held) == 1 else b"".join(held)
        packed_digest.update(piece)
        done += len(piece)
        if progress:
            progress(done, size)
        if piece:
            yield piece

    plain = compression == encryption == "none"
    file.seek(HEADER.size)
    n = 0
    for piece in PIECES[compression](make, size):
        out = cipher(piece)
        if not plain:  # else both digests are of the same bytes
            encoded_digest.update(out)
        file.write(out)
        n += len(out)
    version = 4 if encryption != "none" else 3 if compression == "lz77" else 2
    flags = 1 | 2 * (compression != "none") | 4 * (encryption != "none")
    numbers = [_NUMBERS[t][v] for t, v in (("pack", pack), ("compression", compression), ("encryption", encryption))]
    head = HEADER.pack(MAGIC, version, HEADER.size, flags, *numbers, 0, size, n, salt, packed_digest.digest(), (packed_digest if plain else encoded_digest).digest())
    file.seek(0)
    file.write(head)
    if version == 4:
        mac = archive_authenticator(password, salt)
        for piece in _regions(file, 0, HEADER.size + n):
            mac.update(piece)
        file.seek(HEADER.size + n)
        file.write(mac.digest())
    file.flush()
    return HEADER.size + n + TAG * (version == 4)


class Opened:
    """A checked archive: header, entries, and pieces of each entry's content. The work file, if there is one, goes when this is closed."""

    def __init__(self, header: Header, entries: list[Entry], packed: BinaryIO, work: BinaryIO | None):
        self.header, self.entries, self._packed, self._work = header, entries, packed, work

    def content(self, e: Entry) -> Iterator[bytes]:
        return _regions(self._packed, e.at, e.size) if e.type_id == 1 else iter(())

    def __enter__(self) -> Opened:
        return self

    def __exit__(self, *_) -> None:
        if self._work is not None:
            self._work.close()


def encoded_payload(file: BinaryIO, password: str = "", allow_legacy_encryption: bool = False, authenticate: bool = True, progress: Progress | None = None) -> Header:
    """The header of an archive after its authentication, if it has any, and the digest of its payload."""
    total = file.seek(0, os.SEEK_END)
    file.seek(0)
    head = file.read(HEADER.size)
    h = read_header(head, total)
    mac = None
    if authenticate and h.encryption != "none":
        _need(bool(password), "archive is encrypted; a password is required")
        _need(h.version == 4 or allow_legacy_encryption, "legacy encrypted archive has no authentication")
        mac = archive_authenticator(password, h.salt) if h.version == 4 else None
    if mac:
        mac.update(head)
    digest, done = hashlib.sha256(), 0
    for piece in _regions(file, HEADER.size, h.encoded_size):
        digest.update(piece)
        if mac:
            mac.update(piece)
        done += len(piece)
        if progress:
            progress(done, h.encoded_size)
    if mac:
        _need(hmac.compare_digest(mac.digest(), file.read(TAG)), "archive authentication failed")
    _need(digest.digest() == h.encoded_digest, "encoded digest differs")
    return h


def open_archive(file: BinaryIO, password: str = "", allow_legacy_encryption: bool = False, work_folder: str | None = None, progress: Progress | None = None) -> Opened:
    """An archive after every check. work_folder: of the work file, the machine's own where it is not given."""
    h = encoded_payload(file, password, allow_legacy_encryption, progress=progress)
    work = None
    try:
        if h.compression == h.encryption == "none":
            _need(h.encoded_size == h.packed_size, "packed size differs")
            _need(h.encoded_digest == h.packed_digest, "packed digest differs")
            packed, base = file, HEADER.size
        else:
            packed = work = tempfile.TemporaryFile(dir=work_folder)
            base, left, cipher, digest, made = 0, h.encoded_size, Cipher(h.encryption, password, h.salt), hashlib.sha256(), 0
            file.seek(HEADER.size)

            def read(n: int) -> bytes:
                nonlocal left
                raw = file.read(min(n, left))
                left -= len(raw)
                return cipher(raw) if raw else raw

            for piece in UNPACKED[h.compression](read, h.packed_size):
                made += len(piece)
                _need(made <= h.packed_size, "packed size differs")
                digest.update(piece)
                packed.write(piece)
            _need(made == h.packed_size, "packed size differs")
            _need(digest.digest() == h.packed_digest, "packed digest differs")
            packed.flush()
        entries = unpacked_entries(packed, base, h.packed_size, h.pack)
        _need(h.version > 1 or all(e.type_id != 8 for e in entries), "version 1 has no hard links")
        check_tree(entries)
    except BaseException:
        if work is not None:
            work.close()
        raise
    return Opened(h, entries, packed, work)


def build(entries: list[Entry], pack: str = "index", compression: str = "none", encryption: str = "none", password: str = "", salt: bytes = bytes(16)) -> bytes:
    """`write_archive` in memory."""
    out = io.BytesIO()
    write_archive(out, entries, pack, compression, encryption, password, salt)
    return out.getvalue()


def decode(data: bytes, password: str = "", allow_legacy_encryption: bool = False, content: bool = True) -> tuple[Header, list[Entry]]:
    """`open_archive` in memory, with the content of every entry."""
    with open_archive(io.BytesIO(data), password, allow_legacy_encryption) as a:
        return a.header, [replace(e, content=b"".join(a.content(e))) if content else e for e in a.entries]
