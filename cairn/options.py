"""Options of the commands: which each one takes, how a command line gives them, and secrets from files."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from .functions.scalars import COMPRESSIONS, ENCRYPTIONS, PACKINGS
from .operators.validate import Invalid

# The options that each command takes. Those that stand alone, and those that may repeat, follow.
COMMANDS = {
    "backup": "-o --pack --compress --encrypt --key-file --include",
    "restore": "-d --key-file --overwrite --allow-legacy-encryption",
    "watch": "-o --pack --compress --encrypt --key-file --include --interval --retain --count --realtime",
    "inspect": "",
    "verify": "--key-file --allow-legacy-encryption",
    "user": "--server --username --account-password-file --tls --tls-ca",
    "remote-backup": "--server --username --account-password-file --name --pack --compress --encrypt --key-file --include --incremental --tls --tls-ca",
    "remote-list": "--server --username --account-password-file --tls --tls-ca",
    "remote-restore": "--server --username --account-password-file -d --key-file --overwrite --tls --tls-ca --allow-legacy-encryption",
}
FLAGS = frozenset("--overwrite --allow-legacy-encryption --realtime --incremental --tls".split())
REPEATED = frozenset(["--include"])
BARE = frozenset(["user", "remote-list"])


@dataclass
class Options:
    command: str
    operands: list[str] = field(default_factory=list)
    values: dict[str, str] = field(default_factory=dict)
    flags: set[str] = field(default_factory=set)
    repeated: dict[str, list[str]] = field(default_factory=dict)

    def required(self, name: str) -> str:
        if name not in self.values:
            raise Invalid(f"{self.command} needs {name}")
        return self.values[name]


def parsed(words: Sequence[str]) -> Options:
    """A command line: the command, then operands and options in any order. An unknown, repeated or incomplete option is refused."""
    if not words or words[0] not in COMMANDS:
        raise Invalid(f"no such command: {words[0] if words else ''}")
    out, allowed, rest = Options(words[0]), COMMANDS[words[0]].split(), iter(words[1:])
    for word in rest:
        if not word.startswith("-") or word == "-":
            out.operands.append(word)
            continue
        if word not in allowed:
            raise Invalid(f"{out.command} takes no option {word}")
        if word in FLAGS:
            if word in out.flags:
                raise Invalid(f"{word} is given twice")
            out.flags.add(word)
            continue
        value = next(rest, None)
        if value is None or value in allowed:
            raise Invalid(f"{word} needs a value")
        if word in REPEATED:
            out.repeated.setdefault(word, []).append(value)
        elif word in out.values:
            raise Invalid(f"{word} is given twice")
        else:
            out.values[word] = value
    if out.command in BARE and out.operands:
        raise Invalid(f"{out.command} takes options only")
    return out


def unsupported(given: DataFrame) -> DataFrame:
    """Rows of given (command, option) whose command does not take the option, or does not exist."""
    spark = given.sparkSession
    known = [(c, o) for c, names in COMMANDS.items() for o in names.split()]
    return given.join(F.broadcast(spark.createDataFrame(known, "command string, option string")), ["command", "option"], "left_anti")


def check_algorithms(pack: str, compression: str, encryption: str, password: str = "", incremental: bool = False) -> bool:
    """Whether a delta may be sent. Algorithms must exist and an encrypting one needs a password; what is encrypted is always sent whole."""
    for name, table in ((pack, PACKINGS), (compression, COMPRESSIONS), (encryption, ENCRYPTIONS)):
        if name not in table.values():
            raise Invalid(f"no such algorithm: {name}")
    if encryption != "none" and not password:
        raise Invalid("encryption needs a password")
    return incremental and encryption == "none"


def file_secret(path: str) -> str:
    """A password from a file, line ends at its end dropped; an empty one is refused. Secrets are never columns or options of a reader."""
    with open(path, "rb") as f:
        value = f.read().rstrip(b"\r\n")
    if not value:
        raise Invalid("the password file is empty")
    return value.decode("utf-8", "surrogateescape")


def settled(explicit: dict, configured: dict, defaults: dict, names: Iterable[str] | None = None) -> dict:
    """Explicit options before those of a settings file before defaults, whatever order they were read in."""
    keys = list(names) if names is not None else sorted({*explicit, *configured, *defaults})
    return {k: next((d[k] for d in (explicit, configured, defaults) if d.get(k) is not None), None) for k in keys}
