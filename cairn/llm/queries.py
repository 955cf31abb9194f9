"""The operators of this folder, applied to the driver's tables with production parameters."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import kept_until_release, shared_folder
from .media import media_features, stored_media
from .near_duplicates import near_duplicates
from .packing import pack
from .quality_rules import oracle_sql as quality_sql, quality_rules
from .secret_scan import digest, joined_spans, joined_verdicts, secret_scan
from .source_mixing import mix_sources
from .substring_dedup import without_repeats
from .token_counts import token_counts
from .token_files import read_token_files, write_token_files
from .weak_labels import quality_classifier

VOCABULARY = "word_bpe_49k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    """The file of a public tokenizer: in the folder CAIRN_TOKENIZERS, or where the installed package says."""
    if folder := os.environ.get("CAIRN_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan(documents(spark, sf_dir), owner="source", repository=F.concat_ws("/", "source", "lang"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", digest(F.col("base_spans")).alias("base_sha256"), joined_spans(F.col("spans")).alias("spans"), "n_owned", "n_owner_specific", "n_widely_copied", joined_verdicts(F.col("judged")).alias("verdicts"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(documents(spark, sf_dir), width=200).drop("kept")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), vocabulary_path(), limit=2048)


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), width=3, per=85, of=100)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), capacity=2048, per_source=2)


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "shard", "passes")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = kept_until_release(spark, f"{shared_folder(spark)}/cairn-token-files-{uuid.uuid4().hex}")
    write_token_files(documents(spark, sf_dir), path, vocabulary_path(), end_id=2)
    return read_token_files(spark, path, whole=False).drop("ids")


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(stored_media(documents(spark, sf_dir), tile=64), tiles_col="npy_tiles").drop("tiles")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_secret_scans, op2_suffix_array_dedup, op3_token_counts, op4_minhash_near_dedup, op5_quality_rules, op6_best_fit_packing, op7_source_mixing, op8_token_files, op9_media_columns, op10_quality_classifier)}
ORACLE: dict[str, str] = {"op5_quality_rules": quality_sql()}
