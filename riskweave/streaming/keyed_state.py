"""Streams with state of their own for each company: counts that also fall, and as-of joins. Each gives the rows of a batch function on the same events.

Both wait for the watermark, so that results are final and each is given once. State is kept by Spark (transformWithState, which needs the RocksDB
provider: `use_rocksdb`), is bounded by the longest window and the watermark, and goes on from the checkpoint. Rows that come later than the watermark are left out.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

WINDOWS = (30, 60, 90)
_DAY = 86_400_000


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _counts_schema(windows: tuple[int, ...]) -> str:
    return "company string, day date, " + ", ".join(f"events_{n}d long, high_events_{n}d long" for n in windows)


def counts_by_day(events: DataFrame, windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """Of a static table: events and grave ones (severity 4 and more) of each company in the last so many days, for each day on which one of these numbers changes or
    an event comes or leaves a window. events: event_key, company, severity, published_at; a repeated key counts once. Null companies and times are left out."""
    once = events.where("company IS NOT NULL AND published_at IS NOT NULL").dropDuplicates(["event_key"]).select("company", F.to_date("published_at").alias("day"), (F.col("severity") >= 4).cast("long").alias("high"))
    steps = F.array(F.struct(F.lit(0).alias("after"), *[F.lit(1).alias(f"in_{n}") for n in windows]), *[F.struct(F.lit(w).alias("after"), *[F.lit(-1 if n == w else 0).alias(f"in_{n}") for n in windows]) for w in windows])
    moved = once.select("company", "day", "high", F.explode(steps).alias("s")).select("company", F.date_add("day", F.col("s.after")).alias("day"), "high", "s.*")
    changes = moved.groupBy("company", "day").agg(*[x for n in windows for x in (F.sum(f"in_{n}").alias(f"e{n}"), F.sum(F.col(f"in_{n}") * F.coalesce("high", F.lit(0))).alias(f"h{n}"))])
    so_far = Window.partitionBy("company").orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return changes.select("company", "day", *[x for n in windows for x in (F.sum(f"e{n}").over(so_far).alias(f"events_{n}d"), F.sum(f"h{n}").over(so_far).alias(f"high_events_{n}d"))])


class _Counts(StatefulProcessor):
    """For each company the counts of days in the longest window, and a timer at the end of each day on which something changes."""

    def __init__(self, windows: tuple[int, ...]):
        self.windows = windows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.days = handle.getMapState("days", "day long", "events long, high long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new: dict[int, list[int]] = {}
        for frame in rows:
            days = frame["published_at"].astype("datetime64[ms]").astype("int64") // _DAY
            for day, grave in zip(days.tolist(), (frame["severity"].fillna(0) >= 4).tolist(), strict=True):
                count = new.setdefault(day, [0, 0])
                count[0] += 1
                count[1] += int(grave)
        for day, (n, high) in new.items():
            old = self.days.getValue((day,)) if self.days.containsKey((day,)) else (0, 0)
            self.days.updateValue((day,), (old[0] + n, old[1] + high))
            for after in (0, *self.windows):
                self.handle.registerTimer((day + after + 1) * _DAY)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        today = expiredTimerInfo.getExpiryTimeInMs() // _DAY - 1
        held = {k[0]: v for k, v in self.days.iterator()}
        row = [key[0], pd.Timestamp(today * _DAY, unit="ms").date()]
        for n in self.windows:
            inside = [v for d, v in held.items() if today - n < d <= today]
            row += [sum(v[0] for v in inside), sum(v[1] for v in inside)]
        for d in held:
            if d <= today - max(self.windows):
                self.days.removeKey((d,))
        yield pd.DataFrame([row], columns=["company", "day", *[x for n in self.windows for x in (f"events_{n}d", f"high_events_{n}d")]])

    def close(self) -> None:
        pass


def counts_stream(events: DataFrame, windows: tuple[int, ...] = WINDOWS, late: str = "2 days") -> DataFrame:
    """counts_by_day of a stream: a day's row comes when the watermark has passed its end. State has one entry for each day of the longest window and company."""
    rows = events.where("company IS NOT NULL AND published_at IS NOT NULL").withWatermark("published_at", late).dropDuplicatesWithinWatermark(["event_key"])
    return rows.select("company", "severity", "published_at").groupBy("company").transformWithStateInPandas(_Counts(windows), _counts_schema(windows), "append", "eventTime")


class _AsOf(StatefulProcessor):
    """For each key the panel rows that a point may still need (those since the watermark and the last before), and points that wait for it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getMapState("rows", "at long", "body string")
        self.points = handle.getMapState("points", "at long, n long", "body string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            at = frame["at"].astype("datetime64[ms]").astype("int64")
            for t, is_point, body in zip(at.tolist(), frame["is_point"].tolist(), frame["body"].tolist(), strict=True):
                if not is_point:
                    self.rows.updateValue((t,), (body,))
                    continue
                n = 0
                while self.points.containsKey((t, n)):
                    n += 1
                self.points.updateValue((t, n), (body,))
                self.handle.registerTimer(t + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() - 1
        held = sorted((k[0], v[0]) for k, v in self.rows.iterator())
        before = [r for r in held if r[0] <= now]
        found = before[-1][1] if before else None
        out = []
        for k, v in list(self.points.iterator()):
            if k[0] == now:
                out.append((key[0], v[0], found))
                self.points.removeKey(k)
        for t, _ in before[:-1]:  # timers come in the order of time, so no point needs these any more
            self.rows.removeKey((t,))
        yield pd.DataFrame(out, columns=["key", "point", "row"])

    def close(self) -> None:
        pass


def as_of_stream(points: DataFrame, rows: DataFrame, key: str, at: str, order: str, late: str = "2 days") -> DataFrame:
    """as_of_join of streams: points with the latest row of their key whose `order` is not after the point's `at` (both timestamps, of which a row's is the only one of its
    key; of a repeated one the last that came counts). A point's row comes when the watermark has passed it. Null keys and times are left out."""
    def marked(frame: DataFrame, time: str, is_point: bool) -> DataFrame:
        body = F.to_json(F.struct(*frame.columns), {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
        return frame.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(time).cast("timestamp").alias("at"), F.lit(is_point).alias("is_point"), body.alias("body"))

    both = marked(rows, order, False).union(marked(points, at, True)).withWatermark("at", late)
    found = both.groupBy("key").transformWithStateInPandas(_AsOf(), "key string, point string, row string", "append", "eventTime")
    taken = [c for c in rows.columns if c != key]
    read = lambda c, frame: F.from_json(c, json.dumps(json.loads(frame.schema.json())))
    parsed = found.select(read("point", points).alias("p"), read("row", rows).alias("r"))
    return parsed.select("p.*", *[F.col(f"r.{c}").alias(c) for c in taken])
