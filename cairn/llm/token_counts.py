"""Token counts by the whole-token shortcut.

Which vocabulary strings encode alone as one token is proved once, by asking the library for each;
a pre-token among them counts one. Only the rest is merged, each distinct one once while it is held.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import slices, text_rows, utf8
from .wordpieces import pieces, read_vocabulary


def token_counts(docs: DataFrame, vocabulary_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, n_whole (pre-tokens counted by the shortcut), over_limit (n_tokens > limit).

    Equals the length of the library's encoding without added special tokens, truncation or padding.
    A null or empty text has 0 bytes and tokens. Rows come out one for one, repeated or null ids
    included; other columns, whatever their names, are not read. Rows are independent: no shuffle.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(read_vocabulary(vocabulary_path))

    def count(batches):
        table = pieces(shared)
        for batch in batches:
            for part in slices(batch, 1, 1 << 20):
                raw, at = utf8(part.column(1))
                _, n_tokens, n_whole = table.encode(raw, at)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(at)), pa.array(n_tokens, pa.int64()), pa.array(n_whole, pa.int64())], names=["doc_id", "n_bytes", "n_tokens", "n_whole"])

    rows = text_rows(docs, F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, n_whole long")
    return out.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
