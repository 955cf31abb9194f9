import datetime as dt
import random
import time

import pytest

from cairn.streaming.coalesce import stream_triggers, triggers, watch


def _fold(times, interval):
    out = []
    for t in sorted(times):
        if not out or t > out[-1] + interval:
            out.append(t)
    return out


def test_triggers_equal_the_fold(spark):
    rng = random.Random(1)
    events = [(s, rng.randrange(2000)) for s in range(5) for _ in range(80)] + [(9, 5), (9, 5), (None, 3)]
    got = {}
    for r in triggers(spark.createDataFrame(events, "source long, ts_us long"), 40).collect():
        got.setdefault(r.source, []).append(r.opened)
    for s in {e[0] for e in events}:
        assert sorted(got[s]) == _fold([t for x, t in events if x == s], 40), s


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(2)
    base = dt.datetime(2024, 1, 1)
    times = sorted(rng.randrange(3600) for _ in range(60))
    schema = "source string, ts timestamp"
    for k in range(3):
        part = [("a", base + dt.timedelta(seconds=t)) for t in times[20 * k : 20 * k + 20]]
        if k == 2:
            part.append(("b", base + dt.timedelta(days=2)))
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream_triggers(stream, 300_000_000, "1 second").writeStream.format("memory").queryName("fired").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    start = int(base.replace(tzinfo=dt.timezone.utc).timestamp()) * 1_000_000
    got = sorted((r.opened - start) // 1_000_000 for r in spark.table("fired").where("source = 'a'").collect())
    assert got == _fold(times, 300)


def test_watch():
    calls, waits = [], []

    def flaky():
        calls.append(1)
        if len(calls) in (2, 3):
            raise OSError

    assert watch(flaky, lambda s: waits.append(s), 60, most=3) == 3 and waits == [60, 5.0, 5.0, 60]

    def broken():
        raise OSError

    with pytest.raises(OSError):
        watch(broken, lambda s: False, 0.01)


def test_changes_of_a_tree(spark, tmp_path):
    from cairn.sources import register

    register(spark)
    top = tmp_path / "top"
    top.mkdir()
    (top / "a").write_bytes(b"1")
    q = spark.readStream.format("tree_changes").load(str(top)).writeStream.format("memory").queryName("changed").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
        assert spark.table("changed").count() == 0
        (top / "a").write_bytes(b"22")
        for _ in range(100):
            q.processAllAvailable()
            if spark.table("changed").count():
                break
            time.sleep(0.1)
        rows = spark.table("changed").collect()
        assert len(rows) >= 1 and rows[0].source == str(top)
    finally:
        q.stop()
