"""Precedents by labels against all pairs, extractions that are written twice or not to the end, and inner tables that go."""

import datetime
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from riskweave.operators import retrieval
from riskweave.plans import registry
from riskweave.sources import caches

SF = "/root/testdata/sf0.001"
DAY = datetime.date(2024, 1, 1)


def made(n, seed, spread):
    r = random.Random(seed)
    day = lambda: None if r.random() < 0.15 else DAY + datetime.timedelta(r.randint(0, spread))
    labels = lambda: r.sample("abcde", r.randint(0, 3)) * r.randint(1, 2)
    company = lambda: None if r.random() < 0.1 else ("big" if r.random() < 0.5 else f"c{r.randint(0, 4)}")
    cases = [(i, labels(), company(), day()) for i in r.sample(range(5 * n), n)]
    return cases, [(i, labels(), c, day()) for i, _, c, _ in cases[:: max(1, n // 40)]] + [(-1, ["a", "b"], None, None), (-2, None, "big", DAY)]


def slow_label_top(queries, cases, k):
    out = set()
    for q, wanted, asking, as_of in queries:
        found = [
            (-len({*wanted} & {*had}), i)
            for i, had, c, d in cases
            if wanted and {*wanted} & {*had} and i != q and (c is None or asking is None or c != asking) and (d is None or as_of is None or d <= as_of)
        ]
        out |= {(q, i, -s, r) for r, (s, i) in enumerate(sorted(found)[:k], 1)}
    return out


def test_labels_match_all_pairs(spark):
    for n, spread, k in ((400, 50, 3), (60, 400, 1), (150, 3, 8)):
        cases, queries = made(n, n, spread)
        frames = [spark.createDataFrame(rows, f"{name} long, labels array<string>, {c} string, {d} date") for rows, name, c, d in ((queries, "query_id", "asking", "as_of"), (cases, "case_id", "company", "publish_date"))]
        got = {(r["query_id"], r["case_id"], r["score"], r["rank"]) for r in retrieval.label_top(*frames, k).collect()}
        assert got == slow_label_top(queries, cases, k)
        days, _ = retrieval.known_by_day(frames[1], k)
        worst = days.agg(F.max(F.size("first")), F.count("*"), F.countDistinct("set", "day")).first()
        assert worst[0] <= 2 * (k + 1) and worst[1] == worst[2]  # one row for each set and day, however many cases there are
    assert retrieval.label_top(frames[0], frames[1].limit(0), 3).collect() == [] and retrieval.label_top(frames[0].limit(0), frames[1], 3).collect() == []


def items(spark, n):
    return spark.range(n).select("id", F.concat(F.lit("text "), F.col("id") % 7).alias("text"))


def extract(made):
    def run(rows):
        made.append(rows.count())
        return rows.select("signature", "text", F.upper("text").alias("upper"))

    return run


def test_extractions_of_doubled_and_broken_runs(spark, tmp_path):
    path, made = str(tmp_path / "table"), []
    read = lambda n, how=None, version="v1": caches.read_through(items(spark, n), path, version, ["text"], how or extract(made))

    def doubled(rows):  # another run extracts the same while this one is at it
        caches.read_through(items(spark, 5), path, "v1", ["text"], lambda r: r.select("signature", "text", F.lit("first").alias("upper")))
        return rows.select("signature", "text", F.lit("second").alias("upper"))

    got = read(5, doubled).collect()
    assert len(got) == 5 and {r["upper"] for r in got} == {"first"} and len(caches.batches(spark, path)) == 2
    assert sorted(r["upper"] for r in read(14).collect()) == ["TEXT 5", "TEXT 5", "TEXT 6", "TEXT 6", *["first"] * 10] and made == [2]

    broken = Path(path) / caches._batch_name()  # a run that was broken off has left a file and no mark
    (broken / "_temporary").mkdir(parents=True)
    (broken / "part-00000.parquet").write_bytes(b"half")
    assert len(read(20).collect()) == 20 and made == [2]
    before = sorted(map(tuple, read(20).select("id", "upper").collect()))
    caches.compact(spark, path)
    assert len(caches.batches(spark, path)) == 1 and sorted(map(tuple, read(20).select("id", "upper").collect())) == before
    caches.compact(spark, path)
    assert {r["upper"] for r in read(3, version="v2").collect()} == {"TEXT 0", "TEXT 1", "TEXT 2"} and made == [2, 3]
    assert caches.extracted(spark, path, items(spark, 0).withColumn("signature", F.lit(""))).count() == 0


def test_traces_of_a_repeated_run_are_there_once(spark, tmp_path):
    for run in ("one", "two", "one"):
        caches.append_trace(spark.range(2), str(tmp_path / "trace"), run)
    assert spark.read.json(str(tmp_path / "trace")).count() == 4


def _files(folder):
    return [p for p in Path(folder.removeprefix("file:")).rglob("*.parquet")]


@pytest.mark.parametrize("name", ["anomaly_rules", "f2_rank_pct", "cosine_topk", "ranking_metrics"])
def test_inner_tables_go_once_rows_are_written(spark, tmp_path, name):
    before = len(_files(caches.shared_folder(spark)))
    with caches.inner_tables():
        registry.QUERIES[name](spark, SF).write.parquet(str(tmp_path / "rows"))
    assert len(_files(caches.shared_folder(spark))) == before and spark.read.parquet(str(tmp_path / "rows")).count() > 0


def test_kept_tables_stay_and_errors_leave_none(spark):
    before = len(_files(caches.shared_folder(spark)))
    with caches.inner_tables() as keep_outer:
        with caches.inner_tables() as keep:
            inner = caches.cut(spark.range(3))
            kept = keep(caches.cut(inner.where("id > 0")))
        assert not caches.exists(spark, inner.cut_path) and kept.count() == 2
        other = keep_outer(caches.cut(kept))
    assert not caches.exists(spark, kept.cut_path) and other.count() == 2
    caches.forget(other)
    with pytest.raises(ZeroDivisionError), caches.inner_tables():
        caches.cut(spark.range(3))
        1 / 0
    assert len(_files(caches.shared_folder(spark))) == before
