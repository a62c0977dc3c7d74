"""Replayed stores and change-tested bursts against plain loops; checks that raise; fallbacks of feeds."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from lakeloom.functions import dates, records, scales, text
from lakeloom.functions.intervals import Interval
from lakeloom.operators import events, lookup, stores
from lakeloom.sources import yaml_text

T0 = datetime.datetime(2024, 1, 1)


def plain_replay(log):
    held, out = {}, []
    for owner, at, act, key, value in log:
        box = held.setdefault(owner, {})
        if act == "set":
            done = key in box or not box
            if done:
                box[key] = value
        elif act == "remove":
            done = key in box
            box.pop(key, None)
        else:
            done = act == "get" and key in box
        out.append((owner, at, done, box.get(key)))
    return out


def test_replay_against_a_plain_store(spark):
    rng = random.Random(3)
    for owners, keys in ((1, 2), (7, 3), (3, 1)):
        log = [(rng.choice([None, *range(owners)]), i, rng.choice(["set", "set", "get", "remove", "remove", "other"]), rng.choice([None, *"abc"][: keys + 1]), rng.choice([None, i])) for i in range(900)]
        df = spark.createDataFrame(log, "owner int, at int, act string, key string, value int").repartition(6)
        got = sorted(((r.owner, r["at"], r.accepted, r.result) for r in stores.replay(df, "owner", ["at"], "act", "key", "value").collect()), key=lambda r: r[1])
        assert got == plain_replay(log)


def test_islands_cut_where_the_store_is_empty(spark):
    log = [("a", i, act, key) for i, (act, key) in enumerate([("set", "x"), ("set", "y"), ("remove", "x"), ("get", "y"), ("remove", "y"), ("set", "z"), ("remove", "z"), ("set", "x")])]
    df = spark.createDataFrame(log, "owner string, at int, act string, key string")
    got = {r["at"]: r.island for r in stores.islands(df, "owner", ["at"], F.col("act"), "key").collect()}
    assert [got[i] for i in range(8)] == [1, 1, 1, 1, 1, 2, 2, 3]


def test_debounce_with_a_change_test(spark):
    rng = random.Random(1)
    rows = []
    for key in (None, 1, 2, 3):
        at = T0
        for _ in range(400):
            at += datetime.timedelta(seconds=rng.choice([1, 5, 10, 11, 60]))
            rows.append((len(rows), key, at, rng.choice([None, rng.uniform(0, 30), rng.uniform(0, 30), rng.uniform(0, 300)])))
    df = spark.createDataFrame(rows, "id int, k int, ts timestamp, v double").repartition(5)
    want = []
    for key in (None, 1, 2, 3):
        own, last = [r for r in rows if r[1] == key], None
        for r, after in zip(own, [*own[1:], None], strict=True):
            if (after is None or after[2] - r[2] > datetime.timedelta(seconds=10)) and r[3] is not None and (last is None or abs(r[3] - last) > 20):
                want.append(r[0])
                last = r[3]
    got = events.debounce_changed(df, "k", "ts", "id", F.expr("interval 10 seconds"), "v", 20.0)
    assert sorted(r.id for r in got.collect()) == want and got.columns == df.columns
    assert events.debounce_changed(df.limit(0), "k", "ts", "id", F.expr("interval 10 seconds"), "v", 20.0).count() == 0


@pytest.mark.parametrize(("a", "b", "t", "want"), [
    ("10px 5", "20px 7", 0.5, "15px 6"), ("1", "2 3", 0.25, "1.25 3"), ("1 2 3", "x5", 0.5, "x3"), ("a", "b", 0.5, "b"), ("-1e3,.5", "+1e3,1.5.", 0.5, "0,1."), ("3", "3.0", 0.5, "3"), ("7", "7", 0.3, "7"), ("", "9", 0.5, "9"), ("9", "", 0.5, ""), (None, "1", 0.5, None), ("0", "0.3", 1.0, "0.3"), ("0", "1e-7", 1.0, "1e-7"), ("1", "-4", 0.5, "-1.5"),
])
def test_interpolated_texts(spark, a, b, t, want):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(scales.interpolate_texts(F.col("a"), F.col("b"), t)).first()[0] == want


def test_interpolated_maps(spark):
    df = spark.createDataFrame([({"x": 1.0, "z": 2.0, "n": None}, {"x": 3.0, "y": 5.0, "n": 4.0})], "a map<string, double>, b map<string, double>")
    assert df.select(scales.interpolate_maps(F.col("a"), F.col("b"), 0.25)).first()[0] == {"x": 1.5, "y": 5.0, "n": 4.0}


def test_author_marks_and_lines(spark):
    raw = "@a{k,\n  author = {A*, B† & C^2},\n  title = {x * y},\n my abbr = {q},\n  abbrev = {s},\n  author = {D*}}"
    got = spark.createDataFrame([(raw,)], "t string").select(text.strip_fields(F.col("t"), "abbr")).first()[0]
    assert got == "@a{k,\n  author = {A, B  C2},\n  title = {x * y},\n  abbrev = {s},\n  author = {D*}}"


def test_required_types_raise(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "n int, s string")
    assert df.select(records.required("config", {"n": "int|long", "s": "string|null"}).alias("ok")).collect() == [(True,), (True,)]
    with pytest.raises(Exception, match="config: option n is int, expected string"):
        df.select(records.required("config", {"n": "string"})).collect()


def test_full_names(spark):
    df = spark.createDataFrame([(["Ann B. Lee", "Roe, Jo", "Plato"],), ([],), (None,)], "names array<string>")
    assert [r[0] for r in df.select(text.full_names(F.col("names"))).collect()] == ["Lee, Ann B. and Roe, Jo and Plato", "", None]


def test_filtered_intervals_go_both_ways(spark):
    fridays = lambda t: F.dayofweek(t) == 6
    day = Interval("day")
    df = spark.createDataFrame([(datetime.datetime(2024, 5, 1, 12),), (datetime.datetime(2024, 5, 3),)], "t timestamp")
    got = df.select(day.floor_where(F.col("t"), fridays, 10).cast("date"), day.ceil_where(F.col("t"), fridays, 10).cast("date")).collect()
    assert [tuple(map(str, r)) for r in got] == [("2024-04-26", "2024-05-03"), ("2024-05-03", "2024-05-03")]
    assert df.select(day.ceil_where(F.col("t"), lambda t: F.lit(False), 5)).first()[0] is None


def test_unused_clock(spark):
    assert spark.range(1).select(dates.time_format(F.lit("2024-02-03 04:05:06").cast("timestamp"), "%x|%X|%c")).first()[0] == "2/3/2024|4:05:06 AM|2/3/2024, 4:05:06 AM"


@pytest.mark.parametrize(("url", "safe"), [("a&b", False), ("a/b&c", True), ("a?b:c", True), ("a", True), ("", True), ("http://x", True), ("http", True), ("HTTPS:", True), ("javascript:x", False), ("x:y", False), ("&", False), ("#&:", True), ("data:image/png;base64,aGk=", True), ("data:text/html;base64,aGk=", False)])
def test_safe_urls(spark, url, safe):
    assert spark.createDataFrame([(url,)], "u string").select(lookup.safe_url(F.col("u"))).first()[0] is safe


@pytest.mark.parametrize(("body", "want"), [
    ("a: 1\nb:\n  c: 'x # y' # z\n  d: \"q\"", [("a", "1"), ("b.c", "x # y"), ("b.d", "q")]), ("- 1\n- a: 2\n  b: 3\n-\n  c: 4", [("[0]", "1"), ("[1].a", "2"), ("[1].b", "3"), ("[2].c", "4")]), ("k:\n- x\n- y\nl: z", [("k[0]", "x"), ("k[1]", "y"), ("l", "z")]),
    ("a:\n  - b:\n      - c: 1\n        d: 2\n      - c: 3\n    e: 4", [("a[0].b[0].c", "1"), ("a[0].b[0].d", "2"), ("a[0].b[1].c", "3"), ("a[0].e", "4")]), ("u: http://a:1/b", [("u", "http://a:1/b")]), ("", []), (None, []), ("# only\n\n", []), ("t: |-\n  a\n\n  b\nz: 1", [("t", "a\n\nb"), ("z", "1")]), ("l: []\nm: [a]", [("m[0]", "a")]),
])
def test_yaml_of_any_depth(body, want):
    assert yaml_text.values(body) == want
