"""Bounded coalescing of change events: the first event after a trigger opens a window of fixed length, later ones do not extend it, and the trigger fires at its end.

Neither session windows (which later events extend) nor tumbling windows (which begin at the epoch's
multiples) are the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F


def triggers(events: DataFrame, interval_us: int, source: str = "source", ts: str = "ts_us") -> DataFrame:
    """source, opened, fires (microseconds) of all windows of a table of events.

    An event later than the interval after the event before it opens a window whatever went before.
    So the fold runs over stretches between such gaps, and a source with most of the events is as
    many pieces of work as it has gaps.
    """
    w = W.partitionBy(source).orderBy(ts)
    gap = F.coalesce(F.col(ts) > F.lag(ts).over(w) + interval_us, F.lit(True))
    marked = events.select(source, ts).where(F.col(ts).isNotNull()).withColumn("_new", gap.cast("long"))
    stretches = marked.withColumn("_s", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, W.currentRow))).select(source, "_s", F.col(ts).cast("long").alias("_t"))
    kind = events.schema[source].dataType.simpleString()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come stretch by stretch, in order of time: what is held is the window that is open.
        last, until = None, 0
        for batch in batches:
            keep = []
            for k, (name, stretch, t) in enumerate(zip(*(batch.column(j).to_pylist() for j in range(3)), strict=True)):
                if (name, stretch) != last or t > until:
                    keep.append(k)
                    last, until = (name, stretch), t + interval_us
            some = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(2)], names=[source, "opened"])

    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    opened = stretches.repartition(n, source, "_s").sortWithinPartitions(source, "_s", "_t").mapInArrow(fold, f"`{source}` {kind}, opened long")
    return opened.withColumn("fires", F.col("opened") + interval_us)


def stream_triggers(events: DataFrame, interval_us: int, delay: str = "10 minutes", source: str = "source", ts: str = "ts") -> DataFrame:
    """The same over a stream of (source, ts: timestamp): a row when a window's end is passed by the watermark.

    State of a source is its open window and the events that wait, in order; events later than the
    watermark are dropped by Spark, as the reference's own clock has no late events.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held, last = (list(state.get[0]), state.get[1]) if state.exists else ([], None)
        if not state.hasTimedOut:
            for frame in frames:
                held += [int(x.value // 1000) for x in pd.to_datetime(frame["ts"])]
        now = state.getCurrentWatermarkMs() * 1000
        out, rest = [], sorted(held)
        while rest:
            if last is not None and rest[0] <= last + interval_us:
                rest.pop(0)
            elif rest[0] + interval_us <= now:
                last = rest.pop(0)
                out.append((key[0], last, last + interval_us))
            else:
                break
        if rest:
            state.update((rest, last))
            state.setTimeoutTimestamp(max((rest[0] + interval_us) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        elif last is not None:
            state.update(([], last))
        yield pd.DataFrame(out, columns=[source, "opened", "fires"])

    rows = events.withWatermark(ts, delay).select(source, F.col(ts).alias("ts"))
    kind = rows.schema[source].dataType.simpleString()
    return rows.groupBy(source).applyInPandasWithState(step, f"{source} {kind}, opened long, fires long", "held array<long>, last long", "append", "EventTimeTimeout")


def watch(snapshot: Callable[[], None], wait: Callable[[float], bool], interval_s: float, most: int = 0, retries: int = 3) -> int:
    """Periodic runs: at once, then `interval_s` after each one ended, `most` of them (0: until wait() says stop).

    A failure is tried again after the interval held to 0.1 to 5 seconds, `retries` times in a row; a
    success resets the count; the next failure is raised. wait(seconds) returns whether to stop.
    """
    done = failures = 0
    while True:
        try:
            snapshot()
            done, failures = done + 1, 0
        except Exception:
            failures += 1
            if failures > retries:
                raise
            if wait(min(max(interval_s, 0.1), 5.0)):
                return done
            continue
        if most and done >= most or wait(interval_s):
            return done
