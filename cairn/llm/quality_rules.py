"""Quality rules: a table of thresholds compiled into one projection of Spark's own expressions.

No rule needs more than its own row, so the plan is a scan and a chain of projections: no shuffle,
no Python. Word lists stay inside the row; positions of repeated windows come from sorting the
windows' 64-bit hashes within the row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACE_RUN, SPACES, WORD, fenced

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = """
a an and are as at be by for from in is it of on or that the this to was were with
als auf das dem den der des die ein eine für im in ist mit nicht sich und von zu
au aux dans de des du elle en est et il la le les par pas pour que qui sur un une
con de del el en es la las lo los no para por que se su un una y
""".split()


@dataclass(frozen=True)
class Rule:
    """Reject where 100 * over > percent * under (`most`), or 100 * over < percent * under (not `most`), on documents of `least` words or more."""

    name: str
    over: str
    under: str
    percent: int
    most: bool = True
    least: int = 0

    def failed(self) -> Column:
        left, right = F.lit(100) * F.col(self.over), F.lit(self.percent) * F.col(self.under)
        return ((left > right) if self.most else (left < right)) & (F.col("n_words") >= self.least)


#: The base rules come first in the table; contracts fix them.
BASE = (Rule("repeats", "n_repeat_words", "n_words", 50),)
LEAST_WORDS = 50
RULES = (
    Rule("symbols", "n_symbols", "n_words", 20),
    Rule("short_words", "word_chars", "n_words", 250, most=False),
    Rule("long_words", "word_chars", "n_words", 1200),
    Rule("dup_lines", "n_dup_lines", "n_lines", 50),
    Rule("stop_words", "n_stop_words", "n_words", 4, most=False),
)

_BLANK = SPACES.decode()


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stop_words: tuple[str, ...] = tuple(STOP_WORDS), whole: bool = False) -> DataFrame:
    """doc_id and the counts that rules name; a null text counts as empty, an empty text has 0 of everything. `whole`: with all of docs' columns in one, `_row`."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    held = ["_row"] * whole
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("_text"), *([F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")] * whole))
    rows = rows.select("doc_id", *held, "_text", F.trim(F.col("_text"), F.lit(_BLANK)).alias("_bare"))
    rows = rows.select(
        "doc_id",
        *held,
        F.when(F.col("_bare") == "", F.array().cast("array<string>")).otherwise(F.split("_bare", SPACE_RUN)).alias("_words"),
        F.filter(F.split("_text", "\n"), lambda x: x.rlike(WORD)).alias("_lines"),
        F.length(F.translate("_text", _BLANK, "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
    )
    rows = rows.select(
        "doc_id",
        *held,
        "word_chars",
        "n_symbols",
        F.size("_words").cast("long").alias("n_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter(F.transform("_words", F.lower), lambda x: x.isin(*stop_words))).cast("long").alias("n_stop_words"),
        F.transform("_words", lambda x: F.xxhash64(x)).alias("_hashes"),
    )
    n = F.size("_hashes")
    window = lambda x, i: F.xxhash64(x, F.get("_hashes", i + 1), F.get("_hashes", i + 2))
    rows = rows.withColumn("_windows", F.when(n >= 3, F.slice(F.transform("_hashes", window), F.lit(1), F.greatest(n - 2, F.lit(0)))).otherwise(F.array().cast("array<bigint>"))).drop("_hashes")
    # Only texts with an equal pair of windows pay for the sort.
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    placed = F.transform("_windows", lambda x, i: F.struct(x.alias("h"), i.alias("i")))
    rows = rows.withColumn("_sorted", F.when(repeats, F.sort_array(placed)).otherwise(F.lit(None))).drop("_windows")
    twice = F.filter("_sorted", lambda x, i: (x["h"] == F.get("_sorted", i + 1)["h"]) | ((i > 0) & (x["h"] == F.get("_sorted", F.greatest(i - 1, F.lit(0)))["h"])))
    covered = F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
    return rows.withColumn("n_repeat_words", F.when(F.col("_sorted").isNull(), F.lit(0)).otherwise(F.size(F.array_distinct(covered))).cast("long")).drop("_sorted")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The counts of `features`, base_failed, failed (names of the rules that reject, in the table's order) and kept.

    Rows come out one for one, repeated and null ids included. Empty and null texts fail the base
    (under 50 words). An empty table gives an empty result. Other columns are not read.
    """
    return judged(features(docs, id_col, text_col), rules)


def accepted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs that the rules keep, columns as they were; no join, rows carry themselves."""
    return judged(features(docs, id_col, text_col, whole=True), rules).where("kept").select("_row.*")


def judged(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Rows of `features` with the base's and the table's verdicts."""
    base = F.col("n_words") < LEAST_WORDS
    for rule in BASE:
        base = base | rule.failed()
    failed = F.filter(F.array(*(F.when(rule.failed(), F.lit(rule.name)) for rule in rules)), lambda x: x.isNotNull())
    rows = rows.withColumn("base_failed", base).withColumn("failed", failed)
    return fenced(rows.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0)))


def oracle_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same as DuckDB SQL over a view `documents`."""
    checks = " OR ".join(f"(100 * {r.over} {'>' if r.most else '<'} {r.percent} * {r.under} AND n_words >= {r.least})" for r in rules)
    stop = ", ".join(f"'{x}'" for x in STOP_WORDS)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '{WORD}') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM d),
win AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 1, 1))) AS i FROM w)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
c AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(translate(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
  len(lines) AS n_lines, len(list_filter(words, lambda x: lower(x) IN ({stop}))) AS n_stop_words
  FROM w LEFT JOIN cov ON cov.doc_id = w.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > 50 * n_words) AND NOT ({checks}) AS kept FROM c
"""
