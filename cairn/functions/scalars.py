"""Scalar functions on names, sizes, digests and enumerations."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .paths import basename, col, extension

MIB = 1 << 20
DAY = 86_400

# File categories and their extensions.
CATEGORIES = {
    "image": "jpg jpeg png gif bmp webp svg ico tif tiff",
    "document": "txt md pdf doc docx xls xlsx ppt pptx odt ods odp csv rtf",
    "code": "c h cc cpp cxx hpp py js jsx ts tsx java kt rs go rb php cs sh json xml yml yaml toml ini html css scss sql cmake mk",
    "video": "mp4 mkv avi mov wmv flv webm m4v mpg mpeg",
    "audio": "mp3 flac wav ogg aac m4a wma opus",
    "archive": "zip 7z rar tar gz tgz bz2 xz zst bak cab",
    "program": "exe msi com bat deb rpm appimage run dll so dylib",
}
# Entry type numbers, and numbers of the archive's algorithms.
ENTRY_TYPES = {1: "file", 2: "directory", 3: "symlink", 4: "fifo", 5: "character-device", 6: "block-device", 7: "unix-socket", 8: "hardlink"}
PACKINGS = {1: "stream", 2: "index"}
COMPRESSIONS = {0: "none", 1: "rle", 2: "huffman", 3: "lz77"}
ENCRYPTIONS = {0: "none", 3: "chacha20", 4: "aes256"}


def entry_type_name(number: Column | str) -> Column:
    """Label of an entry type; an unknown number raises."""
    return _labelled(col(number), ENTRY_TYPES, "unknown entry type ")


def algorithm_number(name: Column | str, table: dict[int, str]) -> Column:
    """Number of an algorithm's name; an unknown name raises."""
    return _labelled(col(name), {v: k for k, v in table.items()}, "unknown algorithm ")


def _labelled(value: Column, table: dict, complaint: str) -> Column:
    first, *rest = table.items()
    out = F.when(value == F.lit(first[0]), F.lit(first[1]))
    for k, v in rest:
        out = out.when(value == F.lit(k), F.lit(v))
    return out.otherwise(F.raise_error(F.concat(F.lit(complaint), value.cast("string"))).cast("string" if isinstance(first[1], str) else "int"))


def type_of_mode(mode: Column | str) -> Column:
    """Entry type number from the file-type bits of a mode; others raise."""
    # POSIX file-type bits.
    bits = {0o100000: 1, 0o040000: 2, 0o120000: 3, 0o010000: 4, 0o020000: 5, 0o060000: 6, 0o140000: 7}
    return _labelled(col(mode).bitwiseAND(0o170000), bits, "unsupported file type ")


def category(path: Column | str, type_: Column | str) -> Column:
    """Category of a file by its extension, `other` where none has it; empty for anything but files."""
    ext = extension(basename(path))
    out = F.when(col(type_) != "file", F.lit(""))
    for name, exts in CATEGORIES.items():
        out = out.when(ext.isin(*exts.split()), F.lit(name))
    return out.otherwise(F.lit("other"))


def format_bytes(size: Column | str) -> Column:
    """Size in units of 1024, B to TiB; a decimal place below 100 units, none for B."""
    v = col(size).cast("double")
    units = list(enumerate(("B", "KiB", "MiB", "GiB", "TiB")))
    one = lambda k, unit: F.when((v / float(1024**k) >= 100) | F.lit(k == 0), F.format_string("%.0f " + unit, v / float(1024**k))).otherwise(F.format_string("%.1f " + unit, v / float(1024**k)))
    out = F.when(v < 1024, one(*units[0]))
    for k, unit in units[1:4]:
        out = out.when(v < float(1024 ** (k + 1)), one(k, unit))
    return out.otherwise(one(*units[4]))


def user_directory(name: Column | str) -> Column:
    return F.concat(F.lit("users/"), F.sha2(col(name), 256))


def snapshot_prefix(source: Column | str) -> Column:
    return F.concat(F.lit("auto-"), F.substring(F.sha2(col(source), 256), 1, 16), F.lit("-"))


def snapshot_name(source: Column | str, micros: Column | str, salt: Column | str) -> Column:
    """prefix, 20 digits of microseconds, 16 hex digits of salt, `.bak`; names of one source sort by time."""
    return F.concat(snapshot_prefix(source), F.lpad(col(micros).cast("string"), 20, "0"), F.lit("-"), F.substring(F.lower(col(salt)), 1, 16), F.lit(".bak"))


def is_snapshot_of(name: Column | str, prefix: Column | str) -> Column:
    n, p = col(name), col(prefix)
    return F.startswith(n, p) & F.substr(n, F.length(p) + 1).rlike(r"\A[0-9]{20}-[0-9a-f]{16}\.bak\z")


def valid_username(name: Column | str) -> Column:
    return col(name).rlike(r"\A[A-Za-z0-9_.-]{1,64}\z")


def valid_backup_id(name: Column | str) -> Column:
    return col(name).rlike(r"\A[0-9A-Fa-f]{32}\z")


def is_ipv4(text: Column | str) -> Column:
    part = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    return col(text).rlike(rf"\A{part}(\.{part}){{3}}\z")


def parse_server(text: Column | str) -> Column:
    """Struct of host and port of HOST:PORT or [V6]:PORT; null where it is neither or the port is not 1 to 65535."""
    t = col(text)
    host = F.regexp_extract(t, r"\A(.+):([0-9]{1,5})\z", 1)
    port = F.regexp_extract(t, r"\A(.+):([0-9]{1,5})\z", 2)
    number = F.when(port != "", port).otherwise(F.lit("0")).cast("int")
    bare = F.when(host.rlike(r"\A\[.+\]\z"), F.regexp_extract(host, r"\A\[(.+)\]\z", 1)).otherwise(host)
    return F.when((bare != "") & number.between(1, 65535), F.struct(bare.alias("host"), number.alias("port")))


def retry_delay_ms(interval_ms: Column | str) -> Column:
    return F.least(F.greatest(col(interval_ms), F.lit(100)), F.lit(5000))


def percent_done(done: Column | str, total: Column | str) -> Column:
    """0 to 100; an unknown total (0) is 0."""
    d, t = col(done), col(total)
    return F.when(t <= 0, F.lit(0)).otherwise(F.least(F.greatest(F.floor(d * 100 / t), F.lit(0)), F.lit(100))).cast("int")


def display_date(seconds: Column | str, zone: str = "UTC") -> Column:
    """yyyy-MM-dd HH:mm of epoch seconds in a time zone, whatever the session's is."""
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    there = F.convert_timezone(F.lit("UTC"), F.lit(zone), start + F.make_dt_interval(secs=col(seconds).cast("decimal(18,6)")))
    return F.date_format(there, "yyyy-MM-dd HH:mm")


def first_of(*options: Column | str) -> Column:
    """An explicit option, else the configured one, else the default: the first that is not null, in whatever order they were read."""
    return F.coalesce(*(col(x) for x in options))


def short_id(text: Column | str) -> Column:
    return F.concat(F.substring(col(text), 1, 8), F.lit("…"))


def proof(verifier_hex: Column | str, nonce_hex: Column | str) -> Column:
    """SHA-256 of the bytes of verifier and nonce, in hex."""
    return F.sha2(F.concat(F.unhex(col(verifier_hex)), F.unhex(col(nonce_hex))), 256)


def derived_key(password: Column | str, salt: Column | str, rounds: int = 4096) -> Column:
    """Hex of the iterated digest: first password and salt, then `rounds` times the digest and salt. salt: binary."""
    s = col(salt)
    first = F.unhex(F.sha2(F.concat(F.encode(col(password), "UTF-8"), s), 256))
    return F.lower(F.hex(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), first, lambda d, _: F.unhex(F.sha2(F.concat(d, s), 256)))))
