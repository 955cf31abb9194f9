"""Byte-level aggregates: histograms and runs, counted within tasks in numpy and then added."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def _binary(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py() or b"", np.uint8) for x in column]


def _summed(blobs: DataFrame, name: str, count) -> DataFrame:
    def each(batches):
        for batch in batches:
            total = np.zeros(0, np.int64)
            for raw in _binary(batch.column(0)):
                if len(raw):
                    more = count(raw)
                    size = max(len(total), len(more))
                    total = np.pad(total, (0, size - len(total))) + np.pad(more, (0, size - len(more)))
            keys = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(total[keys], pa.int64())], names=[name, "n"])

    content = blobs.schema["content"].dataType.typeName()
    raw = F.encode("content", "UTF-8") if content == "string" else F.col("content")
    return blobs.select(raw.alias("content")).mapInArrow(each, f"{name} long, n long").groupBy(name).agg(F.sum("n").alias("n"))


def byte_histogram(blobs: DataFrame) -> DataFrame:
    """byte, n over all content."""
    return _summed(blobs, "byte", lambda raw: np.bincount(raw))


def run_lengths(blobs: DataFrame, most: int = 128) -> DataFrame:
    """length, n of runs of equal bytes, as run-length coding cuts them: longer runs are several of `most` and a rest."""

    def count(raw: np.ndarray) -> np.ndarray:
        edges = np.flatnonzero(np.concatenate([[True], raw[1:] != raw[:-1], [True]]))
        whole, rest = np.divmod(np.diff(edges), most)
        out = np.bincount(rest[rest > 0], minlength=most + 1)
        out[most] += whole.sum()
        return out

    return _summed(blobs, "length", count)
