"""Functions and operators on the cases that the tables lack: nulls, ties, fallbacks, edges."""

import datetime

import pytest
from pyspark.sql import functions as F

from lakeloom.functions import dates, numfmt, scales, text
from lakeloom.functions.intervals import Interval
from lakeloom.operators import bibliography, datajoin, events, feed, lookup, memo, positional


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_html_attribute_and_fallbacks(spark):
    pages = [
        (1, """<meta property="og:title" content="It's &amp; on"><title>T</title><link rel='canonical' href='https://x/1'> Created in May, 2025 <""", "u1"),
        (2, """<meta property='og:title' content=''><title> Second </title><meta property="og:url" content="https://x/2">""", "u2"),
        (3, """<meta content="late" property="og:title"><p>no title""", "u3"),
        (4, """<title>Fourth</title><meta name="description" content='A "q" d'><meta property="og:image" content="i.png">""", "u4"),
    ]
    df = spark.createDataFrame(pages, "id long, html string, url string")
    got = {r.id: r for r in feed.posts(df, "id", "html", F.col("url"), F.lit("2020-02-03").cast("timestamp")).collect()}
    assert sorted(got) == [1, 2, 3, 4] and got[3].title == "late"  # attributes stand in any order
    assert (got[1].title, got[1].link, got[1].pub_date) == ("It's & on", "https://x/1", datetime.datetime(2025, 5, 1))
    assert (got[2].title, got[2].link) == ("Second", "https://x/2")
    assert (got[4].description, got[4].image, got[4].link) == ('A "q" d', "i.png", "u4")
    ranked = {r.id: (r["rank"], r.xml) for r in feed.items(feed.posts(df, "id", "html", F.col("url"), F.lit("2020-02-03").cast("timestamp"))).collect()}
    assert [ranked[i][0] for i in (1, 2, 3, 4)] == [1, 2, 3, 4] and "<enclosure" in ranked[4][1] and "&#x27;s &amp; on" in ranked[1][1]
    empty = feed.last_build(feed.posts(df.limit(0), "id", "html", F.col("url"), F.lit(None).cast("timestamp")), "2000-01-01")
    assert empty.first()[0] == "Sat, 01 Jan 2000 00:00:00 +0000"


@pytest.mark.parametrize(("raw", "day"), [("June 7, 2026", "2026-06-07"), ("May, 2025", "2025-05-01"), ("may 2025.", "2025-05-01"), ("April 12 2025", "2025-04-12"), ("Posted on  June\t 7,  2026 at noon", "2026-06-07"), ("", None), ("Smarch 2020", None), ("February 30, 2025", None), (None, None)])
def test_parse_post_date(spark, raw, day):
    assert one(spark, dates.parse_post_date(F.lit(raw).cast("string")).cast("string"))[0] == day


def test_cited_by(spark):
    rows = [("Cited by 1,234,567", None, 1234567), ("none", "Cited by 5", None), (None, "Cited by 12", 12), (None, None, None)]
    df = spark.createDataFrame(rows, "a string, b string, n long")
    assert df.filter(~text.cited_by(F.col("a"), F.col("b")).eqNullSafe(F.col("n"))).count() == 0


def test_occurrences_and_terms(spark):
    df = spark.createDataFrame([("aaaa", "aa"), ("xabyab", "ab"), ("x", ""), ("", "a"), (None, "a"), (".*.*", ".*")], "t string, k string")
    got = text.occurrences(df, "t", F.col("t"), F.col("k")).collect()
    assert sorted((r.t, r.start, r.stop) for r in got) == [(".*.*", 0, 2), (".*.*", 2, 4), ("aaaa", 0, 2), ("aaaa", 2, 4), ("xabyab", 1, 3), ("xabyab", 4, 6)]
    html = spark.createDataFrame([("<b>ab</b>cd",)], "h string")
    assert html.select(text.node_contains_term(F.col("h"), "BC"), text.contains_term(F.col("h"), "AB"), text.contains_term(F.col("h"), "")).first() == (False, True, True)


def test_keyed_join_duplicates_and_keys(spark):
    nodes = spark.createDataFrame([(1, 1, "1", "a"), (1, 2, "1", "b"), (1, 3, None, "c")], "g int, pos int, k string, v string")
    data = spark.createDataFrame([(1, 1, 1, "x"), (1, 2, 1, "y"), (1, 3, None, "z"), (1, 4, 9, "w")], "g int, pos int, k int, v string")
    got = sorted((r.side, r.key, r.node_value or "", r.data_value or "") for r in datajoin.keyed(nodes, data, "k", "pos", "v", "g").collect())
    assert got == [("enter", "1", "", "y"), ("enter", "9", "", "w"), ("exit", "1", "b", ""), ("update", "1", "a", "x"), ("update", "null", "c", "z")]
    assert datajoin.keyed(nodes.limit(0), data, "k", "pos", "v", "g").filter("side = 'enter'").count() == 4


def test_intervals(spark):
    ts = lambda s: F.lit(s).cast("timestamp")
    at = lambda c: c.cast("string")
    month, week, day = Interval("month"), Interval("week"), Interval("day")
    assert one(spark, at(month.offset(ts("2024-01-31 05:00:00"), 1)), at(week.floor(ts("2024-05-19 10:00:00"))), at(Interval("monday").floor(ts("2024-05-19")))) == ("2024-03-02 05:00:00", "2024-05-19 00:00:00", "2024-05-13 00:00:00")
    assert one(spark, at(day.ceil(ts("2024-05-19"))), at(day.round(ts("2024-05-19 12:00:00"))), month.count(ts("2024-01-31"), ts("2024-03-01"))) == ("2024-05-19 00:00:00", "2024-05-20 00:00:00", 2)
    assert one(spark, F.size(day.range(ts("2024-02-27 01:00:00"), ts("2024-03-01"))), F.size(day.range(ts("2024-03-01"), ts("2024-02-01"))), day.every(ts("2024-01-01"), 0)) == (2, 0, None)
    with pytest.raises(ValueError):
        Interval("fortnight")


def test_ticks_and_scales(spark):
    v = lambda a, b, n: one(spark, scales.ticks(F.lit(float(a)), F.lit(float(b)), F.lit(n)))[0]
    assert v(0, 1, 5) == [0.0, 0.2, 0.4, 0.6, 0.8, 1.0] and v(10, 0, 2) == [10.0, 5.0, 0.0] and v(3, 3, 4) == [3.0] and v(0, 1000, 10)[1] == 100.0
    x = lambda value: F.lit(value).cast("double")
    assert one(spark, scales.linear(x(5), (5, 5), (0, 10)), scales.linear(x(None), (0, 1), (0, 1), unknown=9), scales.linear(x(3), (0, 1), (0, 10), True), scales.js_round(x(-2.5)), scales.quantize(x(7.6), 5, 0, 100)) == (5.0, 9.0, 10.0, -2, 10.0)
    assert one(spark, scales.range_seq(x(0), x(0), x(1)), scales.bisect_left(F.array().cast("array<double>"), x(1))) == ([], 0)


@pytest.mark.parametrize(("spec", "x", "shown"), [(",", 1234567.0, "1,234,567"), (".2f", 1.005, "1.00"), (".1f", 0.25, "0.3"), ("$,.2f", -1234.5, "-$1,234.50"), (".0%", 0.256, "26%"), (".3s", 42e6, "42.0M"), (".2~s", 1500.0, "1.5k"), ("(d", -3.0, "(3)"), ("08d", -42.0, "-0000042"), (".1f", -0.01, "0.0"), ("f", float("nan"), "NaN"), (".0f", 2.5, "3"), ("x", 255.0, "ff"), ("*^9d", 5.0, "****5****"), (".3e", 1234.5678, "1.235e+3"), ("e", 0.0, "0.000000e+0"), (".3g", 1234.5678, "1.23e+3"), (".3g", 0.00012345, "0.000123"), (".2g", 1e-7, "1.0e-7"), (".3r", 1234.5678, "1230"), (".1r", 0.049, "0.05"), (".2p", 12.345678, "1200%"), ("", 1234.5678, "1234.5678"), ("", 3e15, "3e+15"), ("n", 1234567.0, "1.23457e+6"), (".9n", 1234567.5, "1,234,567.50"), ("c", 1234.5678, "1234.5678"), (".12~g", 1234.5678, "1234.5678"), (".3s", 1e-26, "0.01y"), (".2r", 99.9, "100"), (",.2f", 123.456, "123.46"), ("$,.1f", -0.01, "$0.0")])
def test_number_formats(spark, spec, x, shown):
    assert one(spark, numfmt.format_number(F.lit(x), spec))[0] == shown


def test_number_format_errors():
    with pytest.raises(ValueError):
        numfmt.parse("..f")
    with pytest.raises(ValueError):
        numfmt.format_number(F.lit(1.0), ".2q")


def test_lookup_sections_and_order(spark):
    points = spark.createDataFrame([(i, float(x)) for i, x in enumerate([-1, 0, 5, 9.9, 10, 99])], "id int, x double")
    bounds = spark.createDataFrame([(0.0, "a"), (5.0, "b"), (10.0, "c")], "lo double, name string")
    got = {r.id: r.name for r in lookup.active_section(points, bounds, "x", "lo", "name").collect()}
    assert got == {0: None, 1: "a", 2: "b", 3: "b", 4: "c", 5: "c"}
    assert [r.id for r in positional.global_ordinal(points, "x", F.col("id")).orderBy("ordinal").collect()] == list(range(6))
    assert {r.id: r.name for r in lookup.active_section(points, bounds, "x", "lo", "name", ranges=3).collect()} == got
    assert [r.id for r in positional.global_ordinal(points, "x", F.col("id"), ranges=4).orderBy("ordinal").collect()] == list(range(6))
    assert positional.global_ordinal(points.limit(0), "x").count() == 0


def test_positions_of_ties_spread_over_ranges(spark):
    same = spark.range(4000).select(F.col("id"), F.lit("2024-01-01").cast("date").alias("day"), (F.col("id") * 7919 % 4000).alias("tie"))
    got = positional.global_ordinal(same, "day", F.col("tie"), ranges=8)
    assert got.filter("ordinal <> tie").count() == 0
    alike = positional.global_ordinal(same.select("day"), "day", ranges=8)
    assert sorted(r.ordinal for r in alike.collect()) == list(range(4000))
    path = [f for f in alike.inputFiles() if f.endswith(".parquet")]
    assert len(path) >= 6 and max(spark.read.parquet(f).count() for f in path) < 1500


def test_zipped_tables(spark):
    a = spark.createDataFrame([(3, "c"), (1, "a"), (None, "n"), (2, "b")], "o int, v string")
    b = spark.createDataFrame([(20, "y"), (10, "x")], "o int, v string")
    assert [tuple(r) for r in datajoin.zipped(a, b, ["o"], "v").orderBy("pos").collect()] == [(0, "n", "x", "update"), (1, "a", "y", "update"), (2, "b", None, "exit"), (3, "c", None, "exit")]
    assert {r.side for r in datajoin.zipped(a.limit(0), b, ["o"], "v").collect()} == {"enter"}


def test_keyed_join_keeps_equal_rows_and_null_places(spark):
    nodes = spark.createDataFrame([(1, 1, "a", "x"), (1, 1, "a", "x"), (1, None, "b", "y"), (None, 4, "c", "z"), (1, 5, "d", None), (1, 5, "d", None), (1, 5, "d", None)], "g int, pos int, k string, v string")
    data = spark.createDataFrame([(1, 1, "a", "p"), (1, 2, "b", "q"), (None, 3, "c", "r"), (2, 4, "c", "s"), (2, 4, "c", "s")], "g int, pos int, k string, v string")
    got = sorted(((r.g or 0, r.key, r.side, r.node_value or "", r.data_value or "") for r in datajoin.keyed(nodes, data, "k", "pos", "v", "g").collect()), key=str)
    assert got == sorted([(1, "a", "update", "x", "p"), (1, "a", "exit", "x", ""), (1, "b", "update", "y", "q"), (0, "c", "update", "z", "r"), (1, "d", "exit", "", ""), (1, "d", "exit", "", ""), (1, "d", "exit", "", ""), (2, "c", "enter", "", "s"), (2, "c", "enter", "", "s")], key=str)
    many = spark.range(25_000).select(F.lit(1).alias("pos"), F.lit("a").alias("k"), F.lit("x").alias("v"))
    sides = datajoin.keyed(many, many.limit(3), "k", "pos", "v").groupBy("side").count()
    assert {r.side: r["count"] for r in sides.collect()} == {"update": 1, "exit": 24_999, "enter": 2}


def test_groups_cells_and_configuration(spark):
    rows = spark.createDataFrame([("a", True), ("a", False), ("b", False)], "g string, v boolean")
    groups = spark.createDataFrame([("a",), ("b",), ("empty",)], "g string")
    assert {r.g: r.hidden for r in memo.hidden_groups(rows, groups, F.col("v"), "g").collect()} == {"a": False, "b": True, "empty": True}
    docs = spark.createDataFrame([(1, [(["p", "q"], "/u"), (["r"], None)], ["c"])], "id int, items array<struct<values array<string>, url string>>, css array<string>")
    got = sorted(tuple(r)[1:] for r in memo.cells(docs, "id", "items", "css").collect())
    assert got == [(0, 0, "p", "c", None), (0, 1, "q", "", "/u"), (1, 0, "r", "c", None)]


def test_bibtex(spark):
    text_ = '% c\n@article{k1, title = {A {B {C}} d}, year=2001, year = "2002", month = jan,}\n@comment{no}\n@string{x = "y"}\n@Book{k2,title={T}}'
    out = bibliography.entries(spark.createDataFrame([(1, text_), (2, None)], "id int, t string"), "id", "t").collect()
    assert [(r.entry_type, r.citation_key, r.tags.get("year")) for r in sorted(out, key=lambda r: r.ord)] == [("article", "k1", "2002"), ("book", "k2", None)]
    deep = "@a{k, t = " + "{" * 40 + "x" + "}" * 40 + ', q = "a {b} c", u = v}@b{open, t = {x'
    (row,) = bibliography.entries(spark.createDataFrame([(1, deep)], "id int, t string"), "id", "t").collect()
    assert row.tags == {"t": "{" * 39 + "x" + "}" * 39, "q": "a {b} c", "u": "v"}


def test_grid_and_citations(spark):
    lines = positional.diagram_lines(spark.createDataFrame([(1, '\na"b"\nxy\n\nz\n')], "id int, t string"), "id", "t")
    flags = lines.select("y", positional.quoted(F.col("line"), positional.characters(F.col("line"))).alias("q")).orderBy("y").collect()
    assert [r.q for r in flags] == [[False, False, True, True], [False, False], [False]]
    ring = {r.y: r.ring for r in positional.around(lines, "id").collect()}
    assert (ring[0][0], ring[1][1], ring[3]) == ('    " xy', 'a"bx    ', [" " * 8])
    cites = spark.createDataFrame([(1, 1, "a, b"), (1, 2, "b,c")], "doc int, pos int, keys string")
    assert {r.key: r.number for r in positional.collected_keys(cites, "doc", "pos", "keys").collect()} == {"a": 0, "b": 1, "c": 2}
    raw = {r.key for r in positional.collected_keys(cites, "doc", "pos", "keys", trim=False).collect()}
    assert raw == {"a", " b", "b", "c"}


def test_event_gaps(spark):
    t0 = datetime.datetime(2024, 1, 1)
    rows = [(i, 1, t0 + datetime.timedelta(seconds=s)) for i, s in enumerate([0, 10, 20, 31, 100])]
    df = spark.createDataFrame(rows, "id int, k int, ts timestamp")
    kept = {r.id for r in events.debounce(df, "k", "ts", "id", F.expr("interval 10 seconds")).collect()}
    assert kept == {2, 3, 4}  # a gap equal to the limit still joins
    assert [(r.ts - t0).seconds for r in events.throttle(df, "k", "ts", 10).orderBy("ts").collect()] == [0, 20, 31, 100]
