"""Small stores: account tables, history records, server settings."""

from __future__ import annotations

import os
import re
import struct
import uuid
from dataclasses import dataclass

from ..functions.codecs import Malformed

# Magics, limits and settings of the stores.
USERS, RECORD, MOST_USERS, MOST_RECORDS = b"USR1", b"MET1", 100_000, 4096
_NAME = re.compile(r"[A-Za-z0-9_.-]{1,64}\Z")


@dataclass(frozen=True)
class User:
    name: str
    salt: bytes
    verifier: bytes


@dataclass(frozen=True)
class Backup:
    name: str
    timestamp: int
    size: int
    digest: str


def _need(test: bool, what: str) -> None:
    if not test:
        raise Malformed(what)


def dump_users(users: list[User]) -> bytes:
    return USERS + struct.pack("<I", len(users)) + b"".join(struct.pack("<H", len(u.name)) + u.name.encode() + u.salt + u.verifier for u in users)


def load_users(data: bytes | None) -> list[User]:
    """Accounts of a store; a store that does not exist (None) has none."""
    if data is None:
        return []
    _need(data[:4] == USERS and len(data) >= 8, "bad account store")
    (n,), at, out = struct.unpack_from("<I", data, 4), 8, []
    _need(n <= MOST_USERS, "too many accounts")
    for _ in range(n):
        _need(at + 2 <= len(data), "account store ends early")
        (k,) = struct.unpack_from("<H", data, at)
        _need(at + 2 + k + 48 <= len(data), "account store ends early")
        name = data[at + 2 : at + 2 + k].decode("latin-1")
        _need(bool(_NAME.match(name)), "invalid account name")
        at += 2 + k
        out.append(User(name, data[at : at + 16], data[at + 16 : at + 48]))
        at += 48
    _need(at == len(data), "account store has trailing data")
    _need(len({u.name for u in out}) == len(out), "duplicate account")
    return out


def dump_backup(b: Backup) -> bytes:
    name = b.name.encode()
    return RECORD + struct.pack("<H", len(name)) + name + struct.pack("<QQ", b.timestamp, b.size) + b.digest.encode()


def load_backup(data: bytes) -> Backup:
    _need(data[:4] == RECORD and len(data) >= 6, "bad history record")
    (k,) = struct.unpack_from("<H", data, 4)
    _need(k <= 256 and len(data) == 6 + k + 16 + 64, "history record has the wrong size")
    digest = data[-64:].decode("latin-1")
    _need(bool(re.match(r"[0-9a-f]{64}\Z", digest)), "bad digest")
    return Backup(data[6 : 6 + k].decode(), *struct.unpack_from("<QQ", data, 6 + k), digest)


def store(path: str, data: bytes) -> None:
    """Replace a file whole or not at all: a new file beside it, written through, takes its name, and the folder is written through."""
    folder = os.path.dirname(os.path.abspath(path))
    staged = f"{path}.{uuid.uuid4().hex}.part"
    try:
        with open(os.open(staged, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600), "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.replace(staged, path)
    finally:
        if os.path.exists(staged):
            os.unlink(staged)
    at = os.open(folder, os.O_RDONLY | os.O_DIRECTORY)
    try:
        os.fsync(at)
    finally:
        os.close(at)


def held(path: str) -> bytes | None:
    """A store's bytes, None where it does not exist."""
    try:
        with open(path, "rb") as f:
            return f.read()
    except FileNotFoundError:
        return None


def save_users(path: str, users: list[User]) -> None:
    data = dump_users(users)
    _need(load_users(data) == users, "accounts that cannot be read again")
    store(path, data)


def save_backup(path: str, backup: Backup) -> None:
    data = dump_backup(backup)
    _need(load_backup(data) == backup, "a record that cannot be read again")
    store(path, data)


def account_history(folder: str) -> list[tuple[str, Backup]]:
    """(id, record) of an account's folder, newest first; more than MOST_RECORDS raise."""
    ids = [x[:-5] for x in os.listdir(folder) if re.match(r"[0-9A-Fa-f]{32}\.meta\Z", x)]
    _need(len(ids) <= MOST_RECORDS, "too many backups")
    rows = [(i, load_backup(held(os.path.join(folder, f"{i}.meta")) or b"")) for i in ids]
    return sorted(rows, key=lambda r: (-r[1].timestamp, r[0]))


def find_user(users: list[User], name: str) -> User | None:
    return next((u for u in users if u.name == name), None)


def to_wire(kinds: str, *values) -> bytes:
    """Fields as they are sent: `B`, `H`, `I`, `Q` as big-endian numbers, `s` as a length of 16 bits and UTF-8."""
    out = []
    for kind, value in zip(kinds, values, strict=True):
        if kind == "s":
            raw = value.encode("utf-8", "surrogateescape")
            _need(len(raw) < 1 << 16, "string is too long to be sent")
            out.append(struct.pack(">H", len(raw)) + raw)
        else:
            out.append(struct.pack(">" + kind, value))
    return b"".join(out)


def from_wire(kinds: str, data: bytes) -> tuple:
    """The fields of a message, which must end with them."""
    out, at = [], 0
    for kind in kinds:
        n = struct.calcsize(">H" if kind == "s" else ">" + kind)
        _need(at + n <= len(data), "message ends early")
        (value,) = struct.unpack_from(">H" if kind == "s" else ">" + kind, data, at)
        at += n
        if kind == "s":
            _need(at + value <= len(data), "message ends early")
            value, at = data[at : at + value].decode("utf-8", "surrogateescape"), at + value
        out.append(value)
    _need(at == len(data), "message has trailing data")
    return tuple(out)


def load_settings(text: str, known: dict[str, type]) -> dict[str, object]:
    """`key = value` lines; lines that begin with #, ; or [ are passed over; an unknown key or a bad number raises."""
    out: dict[str, object] = {}
    for line in map(str.strip, text.splitlines()):
        if not line or line[0] in "#;[":
            continue
        key, equals, value = (x.strip() for x in line.partition("="))
        _need(bool(equals) and key in known, f"unknown setting: {key}")
        if known[key] is int:
            _need(value.isascii() and value.isdigit(), f"bad number for {key}")
        out[key] = known[key](value)
    return out
