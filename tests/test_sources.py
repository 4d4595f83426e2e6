"""Readers, writers and streaming jobs."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from panelmill.operators import panel
from panelmill.sources import tables as src
from panelmill.streaming import jobs

BARS = [("A", dt.date(2024, 1, 1), "I", "X", 1.0, 2.0, 0.5, 1.5, 10), ("A", dt.date(2024, 1, 2), "I", "X", 1.5, 2.5, 1.0, 2.0, 0)]


def test_bars_round_trip_and_bad_input_fails(spark, tmp_path):
    df = spark.createDataFrame(BARS, src.BARS_SCHEMA)
    path = src.write_table(df, str(tmp_path / "bars.csv"), "csv")
    assert sorted(map(tuple, src.read_bars(spark, path).collect())) == BARS
    bad = tmp_path / "bad.csv"
    bad.write_text("ticker,dt,isin,sector,open,high,low,close,volume\nA,not-a-day,I,X,1,1,1,1,1\n")
    with pytest.raises(Exception):
        src.read_bars(spark, str(bad)).collect()


def test_articles_skip_or_raise(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text(json.dumps({"seq": 1, "title": "t"}) + "\n{broken\n" + json.dumps({"seq": 2}) + "\n")
    assert sorted(r["seq"] for r in src.read_articles(spark, str(path)).collect()) == [1, 2]
    assert src.read_articles(spark, str(path)).count() == 2
    with pytest.raises(Exception):
        src.read_articles(spark, str(path), on_bad="raise").collect()


def test_raw_input_is_never_overwritten(spark, tmp_path):
    with pytest.raises(ValueError):
        src.write_table(spark.range(1), str(tmp_path), raw=(str(tmp_path) + "/",))
    with pytest.raises(ValueError):
        src.read_table(spark, "x.txt", "a int")


def test_backup_keeps_the_old_version(spark, tmp_path):
    root = str(tmp_path / "store")
    first, none = src.replace_with_backup(spark.range(3), root)
    second, backup = src.replace_with_backup(spark.range(5), root)
    assert none is None and backup == first
    assert spark.read.parquet(second).count() == 5 and spark.read.parquet(backup).count() == 3


TICK = "ticker string, ts timestamp, price double"


def feed(spark, path, *slices):
    for rows in slices:
        df = spark.createDataFrame([(k, dt.datetime(2024, 1, d, h), float(p)) for k, d, h, p in rows], TICK)
        df.coalesce(1).write.mode("append").parquet(str(path))
    return jobs.stream_files(spark, str(path), TICK, per_trigger=1)


def test_high_water_equals_its_batch_twin(spark, tmp_path):
    a = [("A", 1, 1, 1), ("A", 2, 1, 2), ("B", 5, 1, 3)]
    b = [("A", 2, 1, 2), ("A", 3, 1, 4), ("B", 4, 1, 5), ("C", 1, 1, 6)]
    out = jobs.run_to_table(jobs.stateful_high_water(feed(spark, tmp_path / "f", a, b), "ticker", "ts"), "hw")
    assert sorted(r["price"] for r in out.collect()) == [1.0, 2.0, 3.0, 4.0, 6.0]
    frame = lambda rows: spark.createDataFrame([(k, dt.datetime(2024, 1, d, h), float(p)) for k, d, h, p in rows], TICK)
    twin = panel.after_high_water(frame(b), frame(a), order="ts")
    assert sorted(r["price"] for r in twin.collect()) == [4.0, 6.0]


def test_stream_dedupe_and_upsert(spark, tmp_path):
    slices = [("A", 1, 1, 1), ("B", 1, 2, 2)], [("A", 1, 3, 3), ("C", 2, 1, 4)]
    once = jobs.run_to_table(jobs.stream_dedupe(feed(spark, tmp_path / "d", *slices), "ticker", "ts", "30 days"), "d")
    assert sorted((r["ticker"], r["price"]) for r in once.collect()) == [("A", 1.0), ("B", 2.0), ("C", 4.0)]
    newest = jobs.stream_upsert(feed(spark, tmp_path / "u", *slices), ["ticker"], "ts")
    assert sorted((r["ticker"], r["price"]) for r in newest.collect()) == [("A", 3.0), ("B", 2.0), ("C", 4.0)]


def test_mode_switch_reads_nothing_twice(spark, tmp_path):
    source, target = str(tmp_path / "s"), str(tmp_path / "t")
    feed(spark, source, [("A", 1, 1, 1)])
    assert jobs.load_or_resume(spark, source, TICK, target) == "full"
    feed(spark, source, [("A", 2, 1, 2)])
    assert jobs.load_or_resume(spark, source, TICK, target) == "incremental"
    assert jobs.load_or_resume(spark, source, TICK, target) == "incremental"
    got = spark.read.parquet(f"{target}/data").groupBy("load_mode").count()
    assert {r["load_mode"]: r["count"] for r in got.collect()} == {"full": 1, "incremental": 1}


def test_feed_of_many_files_keeps_its_batches(spark, monkeypatch, tmp_path):
    """A slice is written by as many tasks as the table has splits and still is one micro-batch, also with few rows or none."""
    from types import SimpleNamespace

    from panelmill.plans import q_streams

    ticks = spark.range(40).repartition(4).selectExpr("id AS event_id", "timestamp_seconds(id) AS ts", "id % 3 AS ticker", "'x' AS event_type", "1.0D AS price")
    monkeypatch.setattr(q_streams, "shared_folder", lambda *_: str(tmp_path / "feed"))
    conditions = ["event_id < 20", "event_id = 30", "event_id > 50", "event_id >= 10"]
    stream = q_streams.arriving(SimpleNamespace(spark=spark, ticks=ticks), *[F.expr(c) for c in conditions])
    sizes = []
    jobs.drain_batches(stream, lambda batch, _: sizes.append(batch.count()), str(tmp_path / "checkpoint"))
    assert sizes == [20, 1, 0, 30] and jobs.count_files(spark, f"{tmp_path}/feed/*.parquet") == 16
