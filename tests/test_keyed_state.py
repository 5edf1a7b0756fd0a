"""Streams with state, held against the batch functions on the same rows."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from riskweave.operators import inquiry
from riskweave.streaming import announcements, keyed_state

START = datetime.datetime(2024, 1, 1)


def written(folder, parts, columns):
    folder.mkdir()
    for i, part in enumerate(parts):
        (folder / f"{i:03}.json").write_text("\n".join(json.dumps(dict(zip(columns, r, strict=True)), default=lambda x: x.isoformat()) for r in part))
        import os

        os.utime(folder / f"{i:03}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    return str(folder)


def run(frame, tmp_path, name):
    query = frame.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(availableNow=True).start()
    assert query.awaitTermination(300)
    return frame.sparkSession.read.schema(frame.schema).parquet(str(tmp_path / name))


@pytest.fixture
def rocksdb(spark):
    keyed_state.use_rocksdb(spark)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_counts_fall_again_and_equal_the_batch(spark, tmp_path, rocksdb):
    r = random.Random(4)
    rows = sorted((START + datetime.timedelta(days=r.randint(0, 60), seconds=r.randint(0, 80_000)), f"k{i}", f"c{i % 3}", r.randint(1, 5)) for i in range(60))
    rows = [(k, c, s, t) for t, k, c, s in rows]
    rows[7] = (*rows[6][:3], rows[7][3])  # a key that comes twice
    end = [("end", "z", 1, START + datetime.timedelta(days=300))]
    parts = [rows[:20], rows[20:40], rows[40:], end, [("late", "c0", 5, START)]]
    source = written(tmp_path / "in", parts, ("event_key", "company", "severity", "published_at"))
    windows = (5, 30)
    got = run(keyed_state.counts_stream(announcements.read_events(spark, source, files_at_once=1), windows), tmp_path, "out")
    on_time = spark.read.schema(announcements.EVENTS).json(source).where("event_key != 'late'")
    want = keyed_state.counts_by_day(on_time, windows)
    rows_of = lambda df: sorted(map(tuple, df.where("company != 'z'").select(sorted(df.columns)).collect()))
    assert rows_of(got) == rows_of(want) and len(rows_of(got)) > 100
    last = got.where("company = 'c1'").orderBy(F.desc("day")).first()
    assert last["events_30d"] == last["high_events_30d"] == 0  # all have left the window


def test_batch_counts_by_day(spark):
    rows = [("a", "x", 5, START), ("a", "x", 5, START), ("b", "x", 1, START + datetime.timedelta(days=3)), ("c", None, 5, START), ("d", "x", None, None)]
    got = {(r["day"].day, r["events_2d"], r["high_events_2d"], r["events_5d"]) for r in keyed_state.counts_by_day(spark.createDataFrame(rows, "event_key string, company string, severity int, published_at timestamp"), (2, 5)).collect()}
    assert got == {(1, 1, 1, 1), (3, 0, 0, 1), (4, 1, 0, 2), (6, 0, 0, 1), (9, 0, 0, 0)}


def test_as_of_stream_equals_the_batch(spark, tmp_path, rocksdb):
    r = random.Random(5)
    moment = lambda: START + datetime.timedelta(hours=r.randint(0, 24 * 40))
    points = sorted(((i, f"c{i % 4}", moment()) for i in range(80)), key=lambda x: x[2])
    panel = sorted({(c, t): (c, t, round(r.random(), 3)) for c, t in ((f"c{r.randint(0, 3)}", moment()) for _ in range(60))}.values(), key=lambda x: x[1])
    end = START + datetime.timedelta(days=200)
    p = written(tmp_path / "points", [points[:30], points[30:], [(900, "z", end)]], ("point_id", "company", "at"))
    q = written(tmp_path / "panel", [panel[: len(panel) // 2], panel[len(panel) // 2 :], [("z", end, 0.0)]], ("company", "known", "roe"))
    schemas = "point_id long, company string, at timestamp", "company string, known timestamp, roe double"
    streams = [spark.readStream.schema(s).json(f) for s, f in zip(schemas, (p, q), strict=True)]
    got = run(keyed_state.as_of_stream(*streams, "company", "at", "known"), tmp_path, "out")
    want = inquiry.as_of_join(spark.read.schema(schemas[0]).json(p), spark.read.schema(schemas[1]).json(q), "company", "at", "known")
    rows = lambda df: sorted((r["point_id"], r["company"], r["known"], r["roe"]) for r in df.where("company != 'z' AND roe IS NOT NULL").collect())
    assert rows(got) == rows(want) and len(rows(got)) > 60 and got.where("company != 'z'").count() == 80
