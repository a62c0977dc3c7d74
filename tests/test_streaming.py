"""Streaming forms against their batch definitions, on files fed with availableNow."""

import datetime

from pyspark.sql import functions as F

from lakeloom.operators import events
from lakeloom.streaming import events as stream


def source(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1)
    rows = [(i, i % 3, t0 + datetime.timedelta(seconds=(i * i * 7) % 4000)) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, k long, ts timestamp").dropDuplicates(["k", "ts"])
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    return df, spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))


def run(df, tmp_path, name):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"c-{name}")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None


def test_throttle_matches_batch(spark, tmp_path):
    batch, live = source(spark, tmp_path)
    run(stream.throttle(live, "k", "ts", 60), tmp_path, "throttled")
    want = {tuple(r) for r in events.throttle(batch, "k", "ts", 60).collect()}
    assert {tuple(r) for r in spark.table("throttled").collect()} == want


def test_debounce_closes_bursts_before_the_watermark(spark, tmp_path):
    batch, live = source(spark, tmp_path)
    run(stream.debounce(live, "k", "ts", "20 seconds", "1 minute"), tmp_path, "debounced")
    want = {(r.k, r.ts) for r in events.debounce(batch, "k", "ts", "id", F.expr("interval 20 seconds")).collect()}
    got = {tuple(r) for r in spark.table("debounced").collect()}
    closed = batch.agg(F.max("ts")).first()[0] - datetime.timedelta(minutes=1)  # the watermark
    assert got == {(k, ts) for k, ts in want if ts + datetime.timedelta(seconds=20) <= closed}
    assert 0 < len(got) < len(want)


def test_gate_opens_once_both_sides_are_there(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1)
    sides = {}
    for name, rows in {"left": [(1, 0), (2, 0), (3, 0), (3, 5)], "right": [(1, 10), (3, 59), (2, 61), (4, 0)]}.items():
        df = spark.createDataFrame([(k, t0 + datetime.timedelta(minutes=m)) for k, m in rows], "k long, ts timestamp")
        df.coalesce(1).write.parquet(str(tmp_path / name))
        sides[name] = spark.readStream.schema(df.schema).parquet(str(tmp_path / name))
    run(stream.gated(sides["left"], sides["right"], "k", "ts"), tmp_path, "gated")
    got = sorted((r.k, (r.ts - t0).seconds // 60, (r._ts - t0).seconds // 60) for r in spark.table("gated").collect())
    assert got == [(1, 0, 10), (3, 0, 59), (3, 5, 59)]


def batches(spark, tmp_path, df, order, n=4):
    """The rows of df as a stream of several files, each a batch, in their order."""
    rows = df.orderBy(*order).collect()
    for i in range(n):
        part = rows[i * len(rows) // n : (i + 1) * len(rows) // n]
        spark.createDataFrame(part, df.schema).coalesce(1).write.parquet(str(tmp_path / "parts" / f"b{i}"))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "parts"))


def events_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    return rows.select("event_id", (F.col("user_id") % 9).alias("user_id"), F.col("ts").cast("timestamp").alias("ts"), "event_type", F.when(F.col("user_id") % 4 > 0, F.col("user_id") % 4).alias("sel"))


def test_refresh_on_change_equals_the_batch_form(spark, tmp_path):
    table = events_table(spark)
    live = batches(spark, tmp_path, table, ["ts", "event_id"])
    run(stream.changes(live, "user_id", "ts", "event_id", "event_type"), tmp_path, "changed")
    want = sorted(r.event_id for r in events.changes(table, "user_id", "ts", "event_id", F.md5("event_type")).collect())
    assert sorted(r.event_id for r in spark.table("changed").collect()) == want and 0 < len(want) < table.count()


def test_handlers_fire_once(spark, tmp_path):
    table = events_table(spark)
    live = batches(spark, tmp_path, table, ["event_id"])
    run(stream.one_shot(live, ["event_type", "sel"], "ts", "event_id", "10000 days"), tmp_path, "fired")
    want = sorted((r.event_type, r.sel or 0, r.first_at) for r in events.first_handlers(table, ["event_type", "sel"], "event_id").collect())
    assert sorted((r.event_type, r.sel or 0, r.first_at) for r in spark.table("fired").collect()) == want


def test_a_handler_is_forgotten_behind_the_watermark(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1)
    rows = [(i, "a" if i in (0, 1, 7) else "b", t0 + datetime.timedelta(hours=i * 2)) for i in range(8)]
    live = batches(spark, tmp_path, spark.createDataFrame(rows, "id long, kind string, ts timestamp"), ["id"], n=8)
    run(stream.one_shot(live, ["kind"], "ts", "id", "1 hour"), tmp_path, "again")
    assert sorted((r.kind, r.first_at) for r in spark.table("again").collect() if r.kind == "a") == [("a", 0), ("a", 7)]
