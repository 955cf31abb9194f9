"""The corpus pipeline: documents in, packed training bins out. Each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cairn.llm.common import staged
from cairn.llm.near_duplicates import deduplicated
from cairn.llm.packing import pack
from cairn.llm.quality_rules import accepted
from cairn.llm.secret_scan import redacted, secret_scan
from cairn.llm.source_mixing import mixed_documents


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the smallest id, and one row of it; rows without an id stay. Groups are of five-word shingles at a similarity of 0.8."""
    return deduplicated(docs, width=5, per=80, of=100)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span found is masked; n_chars follows the text."""
    return _measured(redacted(docs, secret_scan(docs, owner="source", repository=F.concat_ws("/", "source", "lang"))))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and as much of each, as the mix takes; an id may repeat from here on."""
    return _measured(mixed_documents(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, piece, begin, end, bin, place, filled: where each document's words go. All that the mix took of a document is one cluster; without an id, equal texts are."""
    return pack(docs, cluster=F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string"))))


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("secret_scans", secret_scans), ("source_mixing", source_mixing), ("best_fit_packing", best_fit_packing)]
#: Grouping and seeded choice are not SQL; tests/llm/test_pipeline.py holds the result against a plain version.
ORACLE_SQL = None


def _measured(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is a staged table before the next stage reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
