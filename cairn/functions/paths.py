"""Path arithmetic on `/`-separated relative paths, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def depth(path: Column | str) -> Column:
    """Number of components."""
    return F.size(F.split(col(path), "/"))


def basename(path: Column | str) -> Column:
    return F.substring_index(col(path), "/", -1)


def parent(path: Column | str) -> Column:
    """The path without its last component; empty for one component."""
    p = col(path)
    return F.regexp_replace(p, r"/?[^/]*\z", "")


def extension(name: Column | str) -> Column:
    """Lower-case text after the last dot; empty without a dot, or with none but a leading one."""
    return F.lower(F.regexp_extract(col(name), r"(?s)\A.+\.([^.]*)\z", 1))


def ancestors(path: Column | str) -> Column:
    """All strict ancestors, outermost first; none for one component."""
    parts = F.split(col(path), "/")
    n = F.size(parts)
    # sequence(1, 0) counts down, so a single component is kept apart.
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))


def is_inside(child: Column | str, parent_path: Column | str) -> Column:
    """Whether a normalized path is another one or lies below it."""
    c, p = col(child), col(parent_path)
    return (c == p) | F.startswith(c, F.concat(p, F.lit("/")))


def is_safe(path: Column | str) -> Column:
    """Relative, without NUL and without empty, `.` or `..` components."""
    p = col(path)
    return (p != "") & ~p.contains("\0") & F.forall(F.split(p, "/"), lambda x: ~x.isin("", ".", ".."))


def is_hidden(path: Column | str) -> Column:
    """Whether any component begins with a dot: a hidden directory hides what is below."""
    return F.exists(F.split(col(path), "/"), lambda x: x.startswith("."))


def normalized(path: Column | str) -> Column:
    """A selection's spelling: `.` and empty components dropped. Raises on empty, absolute, `..` or a path that names the root."""
    p = col(path)
    parts = F.split(p, "/")
    clean = F.array_join(F.filter(parts, lambda x: ~x.isin("", ".")), "/")
    bad = (p == "") | p.startswith("/") | F.exists(parts, lambda x: x == "..") | (clean == "")
    return F.when(bad, F.raise_error(F.concat(F.lit("invalid selected path: "), p)).cast("string")).otherwise(clean)
