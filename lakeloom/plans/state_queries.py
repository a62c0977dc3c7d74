"""Queries over replayed commands, events that need a change, whole-table positions, and interpolation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, records, scales, text
from ..functions.intervals import Interval
from ..operators import datajoin, events, positional, stores
from ..sources.tables import load


def debounce_changed(spark, d):
    """Ends of bursts whose value differs by more than 20 from the last one acted on."""
    got = events.debounce_changed(load(spark, d, "events").select("event_id", "user_id", "ts", "value"), "user_id", "ts", "event_id", F.expr("interval 6 hours"), "value", 20.0)
    return got.select("event_id", "user_id", "value")


DEBOUNCE_CHANGED = """WITH RECURSIVE e AS (SELECT * FROM (SELECT event_id, user_id, ts, value, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE (n IS NULL OR n > ts + INTERVAL 6 HOUR) AND value IS NOT NULL),
r AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM e),
s AS (SELECT event_id, user_id, value, k, value AS held, true AS acted FROM r WHERE k = 1
UNION ALL SELECT r.event_id, r.user_id, r.value, r.k, CASE WHEN abs(r.value - s.held) > 20 THEN r.value ELSE s.held END, abs(r.value - s.held) > 20 FROM s JOIN r ON r.user_id = s.user_id AND r.k = s.k + 1)
SELECT event_id, user_id, value FROM s WHERE acted"""


def _commands(spark, d):
    """A log of commands from the events: three keys an owner, three kinds of command."""
    e = load(spark, d, "events")
    command = F.element_at(F.array(F.lit("set"), F.lit("get"), F.lit("remove")), (F.col("event_id") % 3 + 1).cast("int"))
    return e.select(F.col("user_id").alias("owner"), "ts", "event_id", command.alias("command"), F.concat(F.lit("k"), (F.floor("value").cast("long") % 3).cast("string")).alias("key"), F.col("event_id").alias("value"))


def keyed_log(spark, d):
    return stores.replay(_commands(spark, d), "owner", ["ts", "event_id"], "command", "key", "value").select("event_id", "command", "accepted", "result")


KEYED_LOG = """WITH RECURSIVE c AS (SELECT user_id AS owner, event_id, ['set', 'get', 'remove'][event_id % 3 + 1] AS command, 'k' || floor(value)::BIGINT % 3 AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
s AS (SELECT owner, event_id, command, n, key AS asked, CASE WHEN command = 'set' THEN key END AS held, CASE WHEN command = 'set' THEN event_id END AS content, command = 'set' AS accepted FROM c WHERE n = 1
UNION ALL SELECT c.owner, c.event_id, c.command, c.n, c.key, CASE WHEN c.command = 'set' AND s.held IS NULL THEN c.key WHEN c.command = 'remove' AND s.held = c.key THEN NULL ELSE s.held END,
CASE WHEN c.command = 'set' AND (s.held IS NULL OR s.held = c.key) THEN c.event_id WHEN c.command = 'remove' AND s.held = c.key THEN NULL ELSE s.content END,
CASE c.command WHEN 'set' THEN s.held IS NULL OR s.held = c.key ELSE s.held IS NOT NULL AND s.held = c.key END FROM s JOIN c ON c.owner = s.owner AND c.n = s.n + 1)
SELECT event_id, command, accepted, CASE WHEN held = asked THEN content END AS result FROM s"""


def data_join_whole(spark, d):
    """Orders by price and customers by balance, row by row over the whole tables."""
    nodes = load(spark, d, "orders").select("o_totalprice", "o_orderkey", F.col("o_orderkey").alias("v"))
    data = load(spark, d, "customer").select(F.col("c_acctbal").alias("o_totalprice"), F.col("c_custkey").alias("o_orderkey"), F.col("c_custkey").alias("v"))
    return datajoin.zipped(nodes, data, ["o_totalprice", "o_orderkey"], "v")


DATA_JOIN_WHOLE = """WITH a AS (SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS pos, o_orderkey AS v FROM orders), b AS (SELECT row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS pos, c_custkey AS v FROM customer)
SELECT coalesce(a.pos, b.pos) AS pos, a.v AS node_value, b.v AS data_value, CASE WHEN a.pos IS NOT NULL AND b.pos IS NOT NULL THEN 'update' WHEN b.pos IS NOT NULL THEN 'enter' ELSE 'exit' END AS side FROM a FULL JOIN b ON a.pos = b.pos"""


def month_positions(spark, d):
    """Lines numbered within the whole table by month, then key: a month is many rows of one leading value."""
    rows = load(spark, d, "lineitem").select(F.trunc("l_shipdate", "month").alias("month"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    ties = [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")]
    placed = positional.global_ordinal(rows, "month", *ties)
    return placed.groupBy(F.date_format("month", "yyyy-MM").alias("month")).agg(F.min("ordinal").alias("first"), F.max("ordinal").alias("last"), F.sum(F.col("ordinal") * (F.col("l_partkey") % 7)).alias("mixed"))


MONTH_POSITIONS = """WITH r AS (SELECT strftime(l_shipdate, '%Y-%m') AS month, l_partkey, row_number() OVER (ORDER BY date_trunc('month', l_shipdate), l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS ordinal FROM lineitem)
SELECT month, min(ordinal) AS first, max(ordinal) AS last, sum(ordinal * (l_partkey % 7))::BIGINT AS mixed FROM r GROUP BY 1"""


def interpolate_texts(spark, d):
    """Half way between two texts with numbers in them; the last number has no partner."""
    whole = lambda c: F.floor(c).cast("long")
    a = F.format_string("m %d,%d h 7 size -%d", whole("l_quantity"), whole("l_extendedprice"), F.col("l_linenumber"))
    b = F.format_string("M %d,%d H 7 size %d end %d", F.col("l_suppkey"), F.col("l_partkey"), F.col("l_linenumber") + 3, F.col("l_orderkey"))
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", scales.interpolate_texts(a, b, 0.5).alias("mid"))


_HALF = lambda x: f"CASE WHEN ({x}) % 2 = 0 THEN (({x}) // 2)::VARCHAR ELSE CASE WHEN ({x}) < 0 THEN '-' ELSE '' END || (abs({x}) // 2) || '.5' END"
INTERPOLATE_TEXTS = f"""SELECT l_orderkey, l_linenumber, l_partkey, 'M ' || {_HALF('floor(l_quantity)::BIGINT + l_suppkey')} || ',' || {_HALF('floor(l_extendedprice)::BIGINT + l_partkey')} || ' H 7 size 1.5 end ' || l_orderkey AS mid FROM lineitem"""


def interpolate_maps(spark, d):
    """Half way between two records with partly different fields."""
    a = F.create_map(F.lit("quantity"), F.floor("l_quantity").cast("double"), F.lit("old"), F.lit(1.0))
    b = F.create_map(F.lit("quantity"), F.col("l_linenumber").cast("double"), F.lit("new"), F.col("l_partkey").cast("double"))
    got = scales.interpolate_maps(a, b, 0.5)
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.element_at(got, "quantity").alias("quantity"), F.element_at(got, "new").alias("new"), F.map_contains_key(got, "old").alias("old"))


INTERPOLATE_MAPS = "SELECT l_orderkey, l_linenumber, l_partkey, (floor(l_quantity) + l_linenumber) / 2::DOUBLE AS quantity, l_partkey::DOUBLE AS new, false AS old FROM lineitem"

#: Format and its SQL twin for each round trip.
_TRIPS = {
    "clock": ("%I:%M:%S.%f %p, %-d %b %Y", "ts"), "weekday": ("%A %e %B %Y %H h", "date_trunc('hour', ts)"), "year_day": ("%j/%Y %X", "date_trunc('second', ts)"), "sunday_week": ("%Y week %U day %w", "date_trunc('day', ts)"), "monday_week": ("%W.%u %Y", "date_trunc('day', ts)"),
    "digits": ("%Y%m%d%H%M%S%L", "date_trunc('millisecond', ts)"), "quarter": ("%q %Y", "date_trunc('quarter', ts)"), "epoch": ("%s%%%L", "date_trunc('millisecond', ts)"), "short": ("%x %H:%M %Z", "date_trunc('minute', ts)"),
}


def time_round_trips(spark, d):
    """Each time written and read again by several formats."""
    back = lambda spec: F.date_format(dates.time_parse(dates.time_format(F.col("ts"), spec.replace("%x", "%-m/%-d/%Y").replace("%X", "%-I:%M:%S %p")), spec), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return load(spark, d, "events").select("event_id", *(back(spec).alias(name) for name, (spec, _) in _TRIPS.items()))


TIME_ROUND_TRIPS = "SELECT event_id, " + ", ".join(f"strftime({sql}, '%Y-%m-%d %H:%M:%S.%f') AS {name}" for name, (_, sql) in _TRIPS.items()) + " FROM events"


def iso_weeks(spark, d):
    """Dates from the year, ISO week and weekday of each order's date, by the year that the week belongs to."""
    t = F.col("o_orderdate")
    iso_year = F.year(F.date_add(F.date_trunc("week", t).cast("date"), 3))
    written = F.concat(iso_year.cast("string"), F.lit("-"), dates.time_format(t, "%V %A"))
    return load(spark, d, "orders").select("o_orderkey", F.date_format(dates.time_parse(written, "%Y-%V %A"), "yyyy-MM-dd").alias("day"))


def busted_urls(spark, d):
    return load(spark, d, "pages").select("page_id", text.busted(F.col("url"), F.col("html")).alias("url"))


def next_fridays(spark, d):
    """The first Friday at or after each order, and the last one at or before it."""
    friday = lambda t: F.dayofweek(t) == 6
    day, t = Interval("day"), F.col("o_orderdate")
    return load(spark, d, "orders").select("o_orderkey", F.date_format(day.ceil_where(t, friday, 8), "yyyy-MM-dd").alias("next"), F.date_format(day.floor_where(t, friday, 7), "yyyy-MM-dd").alias("last"))


NEXT_FRIDAYS = """WITH t AS (SELECT o_orderkey, date_trunc('day', o_orderdate) AS low, date_trunc('day', o_orderdate + INTERVAL 1 DAY - INTERVAL 1 MILLISECOND) AS high FROM orders)
SELECT o_orderkey, strftime(high + to_days(((12 - dayofweek(high)) % 7)::INT), '%Y-%m-%d') AS next, strftime(low - to_days(((dayofweek(low) + 2) % 7)::INT), '%Y-%m-%d') AS last FROM t"""


def full_names(spark, d):
    """Names in both forms, turned to the last name first and joined."""
    names = F.array(F.concat("p_name", F.lit(" "), "p_brand"), F.concat("p_brand", F.lit(", "), "p_type"), F.split("p_type", " ")[0])
    return load(spark, d, "part").select("p_partkey", text.full_names(names).alias("names"))


FULL_NAMES = """SELECT p_partkey, array_to_string(list_transform([p_name || ' ' || p_brand, p_brand || ', ' || p_type, string_split(p_type, ' ')[1]], lambda n: CASE WHEN contains(n, ',') THEN n WHEN contains(n, ' ') THEN regexp_extract(n, '([^ ]+)$', 1) || ', ' || regexp_extract(n, '^(.*) [^ ]+$', 1) ELSE n END), ' and ') AS names FROM part"""


def required_types(spark, d):
    """Events whose columns have the types that they must have; any other would end the query."""
    held = records.required("events", {"event_id": "bigint", "value": "double|null", "props": "string", "ts": "timestamp.*"})
    return load(spark, d, "events").filter(held).groupBy("event_type").agg(F.count("*").alias("n"))


QUERIES = {
    "next_fridays": (next_fridays, NEXT_FRIDAYS),
    "full_names": (full_names, FULL_NAMES),
    "required_types": (required_types, "SELECT event_type, count(*) AS n FROM events GROUP BY 1"),
    "debounce_changed": (debounce_changed, DEBOUNCE_CHANGED),
    "keyed_log": (keyed_log, KEYED_LOG),
    "data_join_whole": (data_join_whole, DATA_JOIN_WHOLE),
    "month_positions": (month_positions, MONTH_POSITIONS),
    "interpolate_texts": (interpolate_texts, INTERPOLATE_TEXTS),
    "interpolate_maps": (interpolate_maps, INTERPOLATE_MAPS),
    "time_round_trips": (time_round_trips, TIME_ROUND_TRIPS),
    "iso_weeks": (iso_weeks, "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders"),
    "busted_urls": (busted_urls, "SELECT page_id, url || '?' || md5(html) AS url FROM pages"),
}
