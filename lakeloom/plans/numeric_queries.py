"""Queries over dates, calendar intervals, scales, ticks, rounding and number formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, numfmt, scales
from ..functions.intervals import Interval
from ..sources.tables import load, spread

_TS = "strftime({}, '%Y-%m-%d %H:%M:%S.%f')"


def _shown(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def date_parse_roundtrip(spark, d):
    when = F.col("o_orderdate")
    kind = F.col("o_orderkey") % 5
    raw = F.when(kind == 0, F.concat(F.lit("Posted on "), F.date_format(when, "MMMM d, yyyy"), F.lit("."))).when(kind == 1, F.date_format(when, "MMMM, yyyy")).when(kind == 2, F.lower(F.date_format(when, "MMMM d yyyy"))).when(kind == 3, F.lit("February 30, 2025")).otherwise(F.lit("Smarch 2020"))
    return load(spark, d, "orders").select("o_orderkey", F.date_format(dates.parse_post_date(raw), "yyyy-MM-dd").alias("day"))


DATE_PARSE = "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-01') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders"


def rfc822_dates(spark, d):
    return load(spark, d, "events").select("event_id", dates.rfc822(F.col("ts")).alias("rfc"))


def date_parts(spark, d):
    t = F.col("o_orderdate")
    return load(spark, d, "orders").select("o_orderkey", F.year(t).cast("long").alias("year"), F.date_format(t, "MMMM").alias("month"), F.date_format(t, "MM").alias("mm"), F.day(t).cast("long").alias("day"), F.date_format(t, "yyyy-MM-dd").alias("iso"), dates.volume(t, 1997).cast("long").alias("volume"), F.month(t).cast("long").alias("issue"))


PARTS = "SELECT o_orderkey, year(o_orderdate) AS year, monthname(o_orderdate) AS month, strftime(o_orderdate, '%m') AS mm, day(o_orderdate) AS day, strftime(o_orderdate, '%Y-%m-%d') AS iso, CASE WHEN year(o_orderdate) > 1997 THEN year(o_orderdate) - 1997 END AS volume, month(o_orderdate) AS issue FROM orders"

_SPEC = "%a|%A|%b|%B|%d|%-d|%H|%I|%j|%m|%M|%p|%S|%u|%w|%U|%W|%V|%y|%Y|%f|%%"


def time_format_parts(spark, d):
    return load(spark, d, "events").select("event_id", dates.time_format(F.col("ts"), _SPEC).alias("shown"), dates.time_format(F.col("ts"), "%e/%q %L %Q").alias("more"))


TIME_FORMAT = f"""SELECT event_id, strftime(ts, '{_SPEC}') AS shown, lpad(day(ts)::VARCHAR, 2, ' ') || '/' || quarter(ts) || ' ' || strftime(ts, '%g') || ' ' || epoch_us(ts) // 1000 AS more FROM events"""


def time_parse(spark, d):
    t = F.col("ts")
    text = F.when(F.col("event_id") % 3 == 0, F.date_format(t, "dd MMMM yy HH:mm:ss")).otherwise(F.date_format(t, "yyyy-MM-dd HH:mm"))
    return load(spark, d, "events").select("event_id", _shown(F.coalesce(dates.time_parse(text, "%Y-%m-%d %H:%M"), dates.time_parse(text, "%d %B %y %H:%M:%S"))).alias("back"))


TIME_PARSE = f"SELECT event_id, {_TS.format('CASE WHEN event_id % 3 = 0 THEN date_trunc(' + chr(39) + 'second' + chr(39) + ', ts) ELSE date_trunc(' + chr(39) + 'minute' + chr(39) + ', ts) END')} AS back FROM events"

UNITS = ("second", "minute", "hour", "day", "week", "month", "year")


def _floor_sql(unit, x):
    return f"date_trunc('week', {x} + INTERVAL 1 DAY) - INTERVAL 1 DAY" if unit == "week" else f"date_trunc('{unit}', {x})"


def _interval_query(op, unit):
    i = Interval(unit)

    def run(spark, d):
        t = F.col("ts").cast("timestamp")
        if op == "count":
            return load(spark, d, "events").select("event_id", i.count(F.lit("2023-11-15 13:00:00").cast("timestamp"), t).alias("n"))
        return load(spark, d, "events").select("event_id", _shown({"floor": i.floor, "ceil": i.ceil, "round": i.round}[op](t)).alias("at"))

    return run


def _interval_sql(op, unit):
    ms = "date_trunc('millisecond', ts)"
    low = f"({_floor_sql(unit, ms)})::TIMESTAMP"
    high = f"({_floor_sql(unit, ms + ' - INTERVAL 1 MILLISECOND')} + INTERVAL 1 {unit.upper()})::TIMESTAMP"
    if op == "floor":
        return f"SELECT event_id, {_TS.format(f'({_floor_sql(unit, chr(116) + chr(115))})::TIMESTAMP')} AS at FROM events"
    if op == "ceil":
        return f"SELECT event_id, {_TS.format(high)} AS at FROM events"
    if op == "round":
        pick = f"CASE WHEN epoch_ms({ms}) - epoch_ms({low}) < epoch_ms({high}) - epoch_ms({ms}) THEN {low} ELSE {high} END"
        return f"SELECT event_id, {_TS.format(pick)} AS at FROM events"
    start = "TIMESTAMP '2023-11-15 13:00:00'"
    return f"SELECT event_id, date_diff('{unit}', ({_floor_sql(unit, start)})::TIMESTAMP, ({_floor_sql(unit, 'ts')})::TIMESTAMP) AS n FROM events" if unit != "week" else f"SELECT event_id, date_diff('day', ({_floor_sql(unit, start)})::TIMESTAMP, ({_floor_sql(unit, 'ts')})::TIMESTAMP) // 7 AS n FROM events"


def interval_weekday(spark, d):
    t = F.col("o_orderdate")
    return load(spark, d, "orders").select("o_orderkey", *(F.date_format(Interval(w).floor(t), "yyyy-MM-dd").alias(w) for w in ("sunday", "monday", "thursday", "saturday")))


WEEKDAYS = "SELECT o_orderkey, " + ", ".join(f"strftime(o_orderdate - to_days(((dayofweek(o_orderdate) - {k} + 7) % 7)::INT), '%Y-%m-%d') AS {w}" for w, k in (("sunday", 0), ("monday", 1), ("thursday", 4), ("saturday", 6))) + " FROM orders"


def interval_offset_month(spark, d):
    return load(spark, d, "orders").select("o_orderkey", F.date_format(Interval("month").offset(F.col("o_orderdate"), (F.col("o_orderkey") % 15 - 7).cast("int")), "yyyy-MM-dd").alias("later"))


OFFSET_MONTH = "SELECT o_orderkey, strftime(date_trunc('month', o_orderdate) + to_months((o_orderkey % 15 - 7)::INT) + to_days((day(o_orderdate) - 1)::INT), '%Y-%m-%d') AS later FROM orders"


def interval_range(spark, d):
    stop = F.timestamp_add("HOUR", (F.col("event_id") % 5 - 1).cast("int"), F.col("ts").cast("timestamp"))
    return load(spark, d, "events").select("event_id", F.explode(Interval("hour").range(F.col("ts"), stop)).alias("at")).select("event_id", _shown(F.col("at")).alias("at"))


RANGE = f"""WITH r AS (SELECT event_id, (date_trunc('hour', date_trunc('millisecond', ts) - INTERVAL 1 MILLISECOND) + INTERVAL 1 HOUR) AS a, (date_trunc('hour', date_trunc('millisecond', ts) + to_hours((event_id % 5 - 1)::INT) - INTERVAL 1 MILLISECOND) + INTERVAL 1 HOUR) AS b FROM events)
SELECT event_id, {_TS.format('unnest(range(a, b, INTERVAL 1 HOUR))')} AS at FROM r"""


def interval_every(spark, d):
    t = F.col("ts")
    return load(spark, d, "events").select("event_id", *(_shown(Interval(u).every(t, k)).alias(f"{u}_{k}") for u, k in (("minute", 15), ("hour", 6), ("day", 2), ("month", 3), ("year", 5), ("second", 20))))


EVERY = f"""SELECT event_id, {_TS.format("date_trunc('minute', ts) - to_minutes((minute(ts) % 15)::INT)")} AS minute_15, {_TS.format("date_trunc('hour', ts) - to_hours((hour(ts) % 6)::INT)")} AS hour_6,
{_TS.format("(date_trunc('day', ts) - to_days(((day(ts) - 1) % 2)::INT))::TIMESTAMP")} AS day_2, {_TS.format("date_trunc('quarter', ts)::TIMESTAMP")} AS month_3, {_TS.format("make_date(year(ts) // 5 * 5, 1, 1)::TIMESTAMP")} AS year_5, {_TS.format("date_trunc('second', ts) - to_seconds((second(ts) % 20)::INT)")} AS second_20 FROM events"""


def _six(c):
    return F.floor(c * 1e6 + 0.5) / 1e6


def _six_sql(x):
    return f"floor(({x}) * 1e6::DOUBLE + 0.5) / 1e6::DOUBLE"


_DOMAIN = (10.0, 20.0, 20.0, 35.5, 41.0)


def bisect(spark, d):
    a = F.array(*map(F.lit, _DOMAIN))
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", scales.bisect_left(a, F.col("l_quantity")).cast("long").alias("lo"), scales.bisect_right(a, F.col("l_quantity")).cast("long").alias("hi"))


BISECT = f"SELECT l_orderkey, l_linenumber, len(list_filter({list(_DOMAIN)}, lambda e: e < l_quantity)) AS lo, len(list_filter({list(_DOMAIN)}, lambda e: e <= l_quantity)) AS hi FROM lineitem"


def range_seq(spark, d):
    return load(spark, d, "part").select("p_partkey", F.posexplode(scales.range_seq(F.lit(1.0), F.col("p_size").cast("double"), F.lit(2.5))).alias("i", "v")).select("p_partkey", F.col("i").cast("long").alias("i"), "v")


RANGE_SEQ = "SELECT p_partkey, i, 1.0::DOUBLE + i * 2.5::DOUBLE AS v FROM (SELECT p_partkey, unnest(range(greatest(ceil((p_size - 1.0::DOUBLE) / 2.5::DOUBLE), 0)::BIGINT)) AS i FROM part)"

_STEP = "(b - a) / 7"
_POWER = "floor(ln(step) / ln(10::DOUBLE))"
_TICKS_SQL = f"""WITH e AS (SELECT p_brand, min(p_retailprice) AS a, max(p_retailprice) + 0.5 AS b FROM part GROUP BY 1), s AS (SELECT *, {_STEP} AS step FROM e), q AS (SELECT *, {_POWER} AS power, step / pow(10::DOUBLE, {_POWER}) AS error FROM s),
i AS (SELECT *, CASE WHEN power >= 0 THEN (CASE WHEN error >= sqrt(50::DOUBLE) THEN 10 WHEN error >= sqrt(10::DOUBLE) THEN 5 WHEN error >= sqrt(2::DOUBLE) THEN 2 ELSE 1 END) * pow(10::DOUBLE, power) ELSE -pow(10::DOUBLE, -power) / (CASE WHEN error >= sqrt(50::DOUBLE) THEN 10 WHEN error >= sqrt(10::DOUBLE) THEN 5 WHEN error >= sqrt(2::DOUBLE) THEN 2 ELSE 1 END) END AS inc FROM q)"""


def _extents(spark, d):
    return load(spark, d, "part").groupBy("p_brand").agg(F.min("p_retailprice").alias("a"), (F.max("p_retailprice") + 0.5).alias("b"))


def ticks(spark, d):
    rows = _extents(spark, d).select("p_brand", F.explode(scales.ticks(F.col("a"), F.col("b"), F.lit(7))).alias("t"))
    return rows.select("p_brand", _six(F.col("t")).alias("t"))


TICKS = f"{_TICKS_SQL} SELECT p_brand, {_six_sql('CASE WHEN inc > 0 THEN k * inc ELSE k / -inc END')} AS t FROM (SELECT p_brand, inc, unnest(range(CASE WHEN inc > 0 THEN ceil(a / inc) ELSE ceil(a * -inc) END::BIGINT, (CASE WHEN inc > 0 THEN floor(b / inc) ELSE floor(b * -inc) END)::BIGINT + 1)) AS k FROM i)"


def tick_step(spark, d):
    return _extents(spark, d).select("p_brand", _six(scales.tick_step(F.col("a"), F.col("b"), F.lit(7))).alias("step"), _six(scales.tick_step(F.col("b"), F.col("a"), F.lit(7))).alias("back"))


TICK_STEP = f"{_TICKS_SQL} SELECT p_brand, {_six_sql('CASE WHEN inc > 0 THEN inc ELSE -1 / inc END')} AS step, {_six_sql('CASE WHEN inc > 0 THEN -inc ELSE 1 / inc END')} AS back FROM i"


def nice_domain(spark, d):
    n = scales.nice(F.col("a"), F.col("b"), F.lit(7))
    return _extents(spark, d).select("p_brand", _six(n[0]).alias("lo"), _six(n[1]).alias("hi"))


NICE = f"{_TICKS_SQL} SELECT p_brand, {_six_sql('CASE WHEN inc > 0 THEN floor(a / inc) * inc ELSE floor(a * -inc) / -inc END')} AS lo, {_six_sql('CASE WHEN inc > 0 THEN ceil(b / inc) * inc ELSE ceil(b * -inc) / -inc END')} AS hi FROM i"


def scale_linear(spark, d):
    x = F.when(F.col("l_orderkey") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("l_quantity"))
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", _six(scales.linear(x, (50, 10), (0, 100), unknown=-1.0)).alias("free"), _six(scales.linear(x, (50, 10), (0, 100), True, -1.0)).alias("held"), _six(scales.linear(x, (5, 5), (0, 100), unknown=-1.0)).alias("flat"))


LINEAR = f"""SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 11 = 0 THEN -1 ELSE {_six_sql('(l_quantity - 50) / -40 * 100')} END AS free, CASE WHEN l_orderkey % 11 = 0 THEN -1 ELSE {_six_sql('(greatest(10::DOUBLE, least(50::DOUBLE, l_quantity)) - 50) / -40 * 100')} END AS held, CASE WHEN l_orderkey % 11 = 0 THEN -1::DOUBLE ELSE 50::DOUBLE END AS flat FROM lineitem"""


def scale_piecewise(spark, d):
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", _six(scales.piecewise(F.col("l_quantity"), [10, 20, 40], [0, 1, 9])).alias("up"), _six(scales.piecewise(F.col("l_quantity"), [40, 20, 10], [0, 1, 9])).alias("down"))


PIECEWISE = f"SELECT l_orderkey, l_linenumber, {_six_sql('CASE WHEN l_quantity < 20 THEN (l_quantity - 10) / 10 ELSE 1 + (l_quantity - 20) / 20 * 8 END')} AS up, {_six_sql('CASE WHEN l_quantity < 20 THEN 9 - (l_quantity - 10) / 10 * 8 ELSE 1 - (l_quantity - 20) / 20 END')} AS down FROM lineitem"


def rounding(spark, d):
    x = (F.col("c_acctbal") - 5000) / 2
    half = F.floor("c_acctbal") - 5000 + 0.5
    return load(spark, d, "customer").select("c_custkey", scales.js_round(half).alias("half"), scales.quantize(x, 25.0, -1000.0, 1500.0).alias("stepped"), _six(scales.interpolate(x, F.lit(7.0), 0.25)).alias("mixed"))


ROUNDING = f"SELECT c_custkey, floor(floor(c_acctbal) - 5000 + 1.0::DOUBLE)::BIGINT AS half, greatest(-1000::DOUBLE, least(1500::DOUBLE, floor((c_acctbal - 5000) / 2 / 25 + 0.5) * 25)) AS stepped, {_six_sql('(c_acctbal - 5000) / 2 * 0.75 + 7 * 0.25')} AS mixed FROM customer"


def interpolate_arrays(spark, d):
    a, b = F.array("l_quantity", "l_tax"), F.array("l_discount", "l_quantity", "l_extendedprice")
    out = scales.interpolate_arrays(a, b, 0.5)
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *(_six(out[i]).alias(f"v{i}") for i in range(3)))


ARRAY_MIX = f"SELECT l_orderkey, l_linenumber, {_six_sql('l_quantity * 0.5 + l_discount * 0.5')} AS v0, {_six_sql('l_tax * 0.5 + l_quantity * 0.5')} AS v1, {_six_sql('l_extendedprice')} AS v2 FROM lineitem"


def curve_samples(spark, d):
    """Curves of each part, sampled in fixed steps from its size on: a bell, a rise and spikes, as a line's points."""
    start = F.col("p_size").cast("double")
    x = F.explode(scales.range_seq(start, start + 10, F.lit(0.5)))
    rows = load(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("price"), x.alias("x"))
    y = scales.gauss(F.col("x"), 25, 8) * F.col("price") + scales.logistic(F.col("x"), 30, 3) + scales.spikes(F.col("x"), [5.0, 12.5, 40.0], 2.0, 0.75)
    return rows.select("p_partkey", _six(F.col("x")).alias("x"), _six(y).alias("y"), F.format_string("%.1f", scales.js_round((F.col("x") - 1) * 12.5 * 10).cast("double") / 10).alias("px"))


CURVE = f"""WITH s AS (SELECT p_partkey, p_retailprice AS price, p_size + unnest(range(20)) * 0.5::DOUBLE AS x FROM part)
SELECT p_partkey, {_six_sql('x')} AS x, {_six_sql('price * exp(-0.5 * pow((x - 25) / 8, 2)) + 1 / (1 + exp(-(x - 30) / 3)) + 2 * exp(-0.5 * pow((x - 5) / 0.75, 2)) + 2 * exp(-0.5 * pow((x - 12.5) / 0.75, 2)) + 2 * exp(-0.5 * pow((x - 40) / 0.75, 2))')} AS y,
printf('%.1f', floor((x - 1) * 12.5::DOUBLE * 10 + 0.5) / 10) AS px FROM s"""


def orthographic_points(spark, d):
    p = scales.orthographic(F.col("c_custkey") % 360 - 180.0, (F.col("c_custkey") * 7) % 180 - 90.0, (100.0, -20.0), 250.0)
    rows = load(spark, d, "customer").select("c_custkey", p.alias("p"))
    return rows.select("c_custkey", _six(F.col("p.x")).alias("x"), _six(F.col("p.y")).alias("y"))


ORTHO = f"""WITH a AS (SELECT c_custkey, radians(c_custkey % 360 - 180 + 100) AS l, radians((c_custkey * 7) % 180 - 90) AS f, radians(-20) AS t FROM customer)
SELECT c_custkey, {_six_sql('cos(f) * sin(l) * 250')} AS x, {_six_sql('-(sin(f) * cos(t) + cos(f) * cos(l) * sin(t)) * 250')} AS y FROM a"""

_SPECS = {"fixed": ".2f", "grouped": ",.1f", "money": "$,.2f", "parens": "(.0f", "percent": ".1%", "padded": "012.1f", "plus": "+,d", "left": "<14.2f", "starred": "*^14d", "hex": "#x", "binary": "b", "octal": "o", "trimmed": ".4~f"}


def num_format(spark, d):
    x = (F.floor("c_acctbal") - 5000) * 1.25
    return spread(load(spark, d, "customer").select("c_custkey", "c_acctbal")).select("c_custkey", *(numfmt.format_number(x, s).alias(n) for n, s in _SPECS.items() if n not in ("hex", "binary", "octal")), *(numfmt.format_number(F.abs(x), s).alias(n) for n, s in _SPECS.items() if n in ("hex", "binary", "octal")))


def _fixed_sql(x, n):
    return f"printf('%.{n}f', floor(abs({x}) * {10**n} + 0.5) / {10**n})"


_SIGN = "CASE WHEN {x} < 0 AND regexp_matches({b}, '[1-9]') THEN '-' ELSE '' END"


def _signed_sql(x, body, plus=""):
    return f"(CASE WHEN {x} < 0 AND regexp_matches({body}, '[1-9]') THEN '-' ELSE '{plus}' END)"


def _comma_sql(x, n):
    return f"format('{{:,}}', floor(floor(abs({x}) * {10**n} + 0.5) / {10**n})::BIGINT)" + (f" || right({_fixed_sql(x, n)}, {n + 1})" if n else "")


NUM_FORMAT = f"""WITH t AS (SELECT c_custkey, (floor(c_acctbal) - 5000) * 1.25::DOUBLE AS x FROM customer)
SELECT c_custkey, {_signed_sql('x', _fixed_sql('x', 2))} || {_fixed_sql('x', 2)} AS fixed, {_signed_sql('x', _fixed_sql('x', 1))} || {_comma_sql('x', 1)} AS grouped, {_signed_sql('x', _fixed_sql('x', 2))} || '$' || {_comma_sql('x', 2)} AS money,
CASE WHEN x < 0 AND regexp_matches({_fixed_sql('x', 0)}, '[1-9]') THEN '(' || {_fixed_sql('x', 0)} || ')' ELSE {_fixed_sql('x', 0)} END AS parens, {_signed_sql('x', _fixed_sql('x * 100', 1))} || {_fixed_sql('x * 100', 1)} || '%' AS percent,
CASE WHEN {_signed_sql('x', _fixed_sql('x', 1))} = '-' THEN '-' || lpad({_fixed_sql('x', 1)}, 11, '0') ELSE lpad({_fixed_sql('x', 1)}, 12, '0') END AS padded, {_signed_sql('x', _fixed_sql('x', 0), '+')} || {_comma_sql('x', 0)} AS plus,
rpad({_signed_sql('x', _fixed_sql('x', 2))} || {_fixed_sql('x', 2)}, 14, ' ') AS left, repeat('*', (14 - length({_signed_sql('x', _fixed_sql('x', 0))} || {_fixed_sql('x', 0)})) // 2) || {_signed_sql('x', _fixed_sql('x', 0))} || {_fixed_sql('x', 0)} || repeat('*', 14 - length({_signed_sql('x', _fixed_sql('x', 0))} || {_fixed_sql('x', 0)}) - (14 - length({_signed_sql('x', _fixed_sql('x', 0))} || {_fixed_sql('x', 0)})) // 2) AS starred,
'0x' || lower(hex(floor(abs(x) + 0.5)::BIGINT)) AS hex, bin(floor(abs(x) + 0.5)::BIGINT) AS binary, format('{{:o}}', floor(abs(x) + 0.5)::BIGINT) AS octal,
{_signed_sql('x', _fixed_sql('x', 4))} || regexp_replace(regexp_replace({_fixed_sql('x', 4)}, '0+$', ''), '[.]$', '') AS trimmed FROM t"""


def num_format_si(spark, d):
    return spread(load(spark, d, "part").select("p_partkey")).select("p_partkey", numfmt.format_number(F.pow(F.col("p_partkey").cast("double"), F.lit(3)) / 1000, ".3s").alias("si"), numfmt.format_number(F.lit(1.5) / (F.col("p_partkey") + 1), ".2~s").alias("small"))


def _digits_sql(x, n):
    """The first n digits of x as a number up to 10 ** n, rounded by the next one; 21 digits of a double tell on which side of a half it is."""
    digits = f"replace(split_part(printf('%.20e', {x}), 'e', 1), '.', '')"
    return f"(left({digits}, {n})::BIGINT + (substr({digits}, {n + 1}, 1) >= '5')::INT)"


NUM_FORMAT_SI = f"""WITH t AS (SELECT p_partkey, pow(p_partkey::DOUBLE, 3) / 1000 AS x, 1.5::DOUBLE / (p_partkey + 1) AS y FROM part),
u AS (SELECT *, split_part(printf('%.20e', x), 'e', 2)::INT AS e, split_part(printf('%.20e', y), 'e', 2)::INT AS f, {_digits_sql('x', 3)} AS d, {_digits_sql('y', 2)} AS c FROM t),
v AS (SELECT p_partkey, CASE WHEN d >= 1000 THEN e + 1 ELSE e END AS e, CASE WHEN d >= 1000 THEN 100 ELSE d END AS d, CASE WHEN c >= 100 THEN f + 1 ELSE f END AS f, CASE WHEN c >= 100 THEN 10 ELSE c END AS c FROM u),
w AS (SELECT *, floor(e / 3.0)::INT AS g, floor(f / 3.0)::INT AS h FROM v)
SELECT p_partkey, CASE e - g * 3 WHEN 0 THEN printf('%.2f', d / 100) WHEN 1 THEN printf('%.1f', d / 10) ELSE d::VARCHAR END || ['m', '', 'k', 'M', 'G', 'T'][g + 2] AS si,
CASE f - h * 3 WHEN 0 THEN regexp_replace(printf('%.1f', c / 10), '[.]0$', '') WHEN 1 THEN c::VARCHAR ELSE (c * 10)::VARCHAR END || ['n', 'µ', 'm', ''][h + 4] AS small FROM w"""

_TYPES = {"general": ".4g", "rounded": ".2r", "share": ".2p", "power": ".3e", "plain": "", "number": ".6n"}


def num_format_types(spark, d):
    x = (F.floor("c_acctbal") - 5000) * F.when(F.col("c_custkey") % 3 == 0, 1000.0).when(F.col("c_custkey") % 3 == 1, 1.0).otherwise(0.125)
    return spread(load(spark, d, "customer").select("c_custkey", "c_acctbal")).select("c_custkey", *(numfmt.format_number(x, s).alias(n) for n, s in _TYPES.items()))


def _eighths(x, n, name):
    """Columns {name}d, {name}e: the first n digits of x / 8 (x a whole number) as a whole number, halves up, and its power of ten."""
    e = f"(length((({x}) // 8)::VARCHAR) - 1)"
    low = f"CASE WHEN ({x}) >= 8 THEN {e} WHEN ({x}) * 10 >= 8 THEN -1 ELSE -2 END"
    raw = f"CASE WHEN {n - 1} >= ({low}) THEN (2 * ({x}) * (10::HUGEINT ** ({n - 1} - ({low})))::HUGEINT + 8) // 16 ELSE (2 * ({x}) + 8 * (10::HUGEINT ** (({low}) - {n - 1}))::HUGEINT) // (16 * (10::HUGEINT ** (({low}) - {n - 1}))::HUGEINT) END"
    return f"CASE WHEN ({raw}) = {10**n} THEN {10 ** (n - 1)} ELSE ({raw}) END AS {name}d, CASE WHEN ({x}) = 0 THEN 0 WHEN ({raw}) = {10**n} THEN ({low}) + 1 ELSE ({low}) END AS {name}e"


def _placed_sql(name, n, comma=False):
    digits = f"lpad({name}d::VARCHAR, {n}, '0')"
    whole = f"left({digits} || repeat('0', greatest({name}e - {n - 1}, 0)::INT), {name}e::INT + 1)"
    whole = f"format('{{:,}}', ({whole})::BIGINT)" if comma else whole
    return f"CASE WHEN {name}e < 0 THEN '0.' || repeat('0', (-{name}e - 1)::INT) || {digits} WHEN {name}e >= {n - 1} THEN {whole} ELSE {whole} || '.' || substr({digits}, {name}e::INT + 2) END"


_POWER = lambda name, n: f"left(lpad({name}d::VARCHAR, {n}, '0'), 1) || '.' || substr(lpad({name}d::VARCHAR, {n}, '0'), 2) || 'e' || CASE WHEN {name}e < 0 THEN '-' ELSE '+' END || abs({name}e)"
_MINUS = "CASE WHEN x < 0 THEN '-' ELSE '' END"
NUM_FORMAT_TYPES = f"""WITH t AS (SELECT c_custkey, (floor(c_acctbal) - 5000)::HUGEINT * CASE c_custkey % 3 WHEN 0 THEN 8000 WHEN 1 THEN 8 ELSE 1 END AS x FROM customer),
u AS (SELECT c_custkey, x, {_eighths('abs(x)', 4, 'g')}, {_eighths('abs(x)', 2, 'r')}, {_eighths('abs(x) * 100', 2, 'p')}, {_eighths('abs(x)', 12, 'c')}, {_eighths('abs(x)', 6, 'n')} FROM t)
SELECT c_custkey, {_MINUS} || CASE WHEN ge >= 4 THEN {_POWER('g', 4)} ELSE {_placed_sql('g', 4)} END AS general, {_MINUS} || {_placed_sql('r', 2)} AS rounded, {_MINUS} || {_placed_sql('p', 2)} || '%' AS share, {_MINUS} || {_POWER('g', 4)} AS power,
{_MINUS} || regexp_replace(regexp_replace({_placed_sql('c', 12)}, '([.][0-9]*?)0+$', '\\1'), '[.]$', '') AS plain, {_MINUS} || CASE WHEN ne >= 6 THEN {_POWER('n', 6)} ELSE {_placed_sql('n', 6, True)} END AS number FROM u"""


def num_format_prefix(spark, d):
    x = F.floor("o_totalprice") * 10 + 3
    return spread(load(spark, d, "orders").select("o_orderkey", "o_totalprice")).select("o_orderkey", numfmt.format_prefix(x, ",.1", 3).alias("thousands"), numfmt.format_prefix(x, ".3f", 7).alias("millions"), numfmt.format_number(F.floor("o_totalprice") - 250_000, "012,d").alias("filled"))


NUM_FORMAT_PREFIX = """WITH t AS (SELECT o_orderkey, floor(o_totalprice)::BIGINT * 10 + 3 AS x, floor(o_totalprice)::BIGINT - 250000 AS y FROM orders)
SELECT o_orderkey, format('{:,}', (x + 50) // 1000) || '.' || ((x + 50) // 100) % 10 || 'k' AS thousands, printf('%.3f', ((x + 500) // 1000) / 1000) || 'M' AS millions,
CASE WHEN y < 0 THEN '-0' ELSE '' END || CASE WHEN y < 0 THEN substr(format('{:,}', 1000000000000 - y), 6) ELSE '0' || substr(format('{:,}', 1000000000000 + y), 6) END AS filled FROM t"""


QUERIES = {
    "date_parse_roundtrip": (date_parse_roundtrip, DATE_PARSE),
    "rfc822_dates": (rfc822_dates, "SELECT event_id, strftime(ts, '%a, %d %b %Y %H:%M:%S') || ' +0000' AS rfc FROM events"),
    "date_parts": (date_parts, PARTS),
    "time_format_parts": (time_format_parts, TIME_FORMAT),
    "time_parse": (time_parse, TIME_PARSE),
    **{f"interval_{op}_{u}": (_interval_query(op, u), _interval_sql(op, u)) for op in ("floor", "ceil", "round", "count") for u in UNITS},
    "interval_weekday": (interval_weekday, WEEKDAYS),
    "interval_offset_month": (interval_offset_month, OFFSET_MONTH),
    "interval_range": (interval_range, RANGE),
    "interval_every": (interval_every, EVERY),
    "bisect": (bisect, BISECT),
    "range_seq": (range_seq, RANGE_SEQ),
    "ticks": (ticks, TICKS),
    "tick_step": (tick_step, TICK_STEP),
    "nice_domain": (nice_domain, NICE),
    "scale_linear": (scale_linear, LINEAR),
    "scale_piecewise": (scale_piecewise, PIECEWISE),
    "rounding": (rounding, ROUNDING),
    "interpolate_arrays": (interpolate_arrays, ARRAY_MIX),
    "curve_samples": (curve_samples, CURVE),
    "orthographic_points": (orthographic_points, ORTHO),
    "num_format": (num_format, NUM_FORMAT),
    "num_format_si": (num_format_si, NUM_FORMAT_SI),
    "num_format_types": (num_format_types, NUM_FORMAT_TYPES),
    "num_format_prefix": (num_format_prefix, NUM_FORMAT_PREFIX),
}
