"""Queries over content records: author lookups, sources, outlines, paths, orders and calendars."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import numfmt, scales
from ..functions.intervals import Interval
from ..operators import lookup
from ..sources.tables import load

#: Marks that a last name may carry.
_MARKS = "¶&*†^"


def author_links(spark, d):
    """Last names without their marks, looked up with the first name; the owner is told apart. Keys compare case-sensitively."""
    rows = load(spark, d, "orders").select("o_orderkey", F.concat(F.when(F.col("o_orderkey") % 3 == 0, F.upper("o_orderstatus")).otherwise(F.lower("o_orderstatus")), F.element_at(F.array(*map(F.lit, ("", *_MARKS))), (F.col("o_orderkey") % 6 + 1).cast("int"))).alias("last"), F.substring_index("o_orderpriority", "-", 1).alias("first"))
    rows = rows.withColumn("key", F.translate("last", _MARKS, ""))
    known = spark.createDataFrame([(0, "f", ["1", "2"], "/f1"), (1, "f", ["2", "3"], "/f2"), (2, "o", ["3"], "/o"), (3, "p", ["1", "5"], "/p")], "ord int, last string, firsts array<string>, href string").withColumnRenamed("last", "name")
    found = lookup.first_match(rows, known, F.expr("key = name and array_contains(firsts, first)"), "ord", "o_orderkey", ["href"])
    return found.select("o_orderkey", "key", ((F.col("key") == "o") & F.col("first").isin("1", "2")).alias("own"), "href")


AUTHOR_LINKS = """WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN upper(o_orderstatus) ELSE lower(o_orderstatus) END AS key, string_split(o_orderpriority, '-')[1] AS f FROM orders)
SELECT o_orderkey, key, key = 'o' AND f IN ('1', '2') AS own, CASE WHEN key = 'f' AND f IN ('1', '2') THEN '/f1' WHEN key = 'f' AND f = '3' THEN '/f2' WHEN key = 'o' AND f = '3' THEN '/o' WHEN key = 'p' AND f IN ('1', '5') THEN '/p' END AS href FROM r"""


def source_union(spark, d):
    """Rows of all configured sources: a feed where one is named, else the listed posts."""
    pages = load(spark, d, "pages").select("page_id", "url")
    sources = {"feed": pages.filter("page_id % 4 < 2"), "posts": pages.filter("page_id % 3 = 0"), "none": pages.limit(0)}
    return reduce(lambda a, b: a.unionByName(b), (df.withColumn("source", F.lit(name)) for name, df in sources.items()))


def selected_papers(spark, d):
    """Flags are set by being there; absent ones are false."""
    flags = load(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "y").alias("selected"))
    rows = load(spark, d, "documents").join(flags, "doc_id", "left")
    return rows.filter("selected is not null").select("doc_id", "lang")


def toc_outline(spark, d):
    """Headings of level 2 and 3 outside a title block and without an opt-out; a third level names the second above it."""
    tag = r"(?is)<(title-block)>.*?</title-block>|<h([23])([^>]*)>(.*?)</h[23]>"
    own = F.concat(F.lit("<title-block><h2>Inside</h2></title-block><h2>First</h2><h3>Sub "), F.col("page_id").cast("string"), F.lit("</h3><h2 no-toc>Out</h2><h3>After</h3><h2 class=x>Last</h2><h3 class='no-toc'>Kept</h3>"))
    rows = load(spark, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all(F.concat(own, "html"), F.lit(tag), F.lit(0))).alias("at", "raw"))
    part = lambda i: F.regexp_extract("raw", tag, i)
    heads = rows.filter((part(1) == "") & ~part(3).rlike(r"(^|\s)no-toc(\s|=|$)")).select("page_id", "at", part(2).cast("long").alias("level"), F.trim(part(4)).alias("heading"))
    above = F.last(F.when(F.col("level") == 2, F.col("heading")), ignorenulls=True).over(Window.partitionBy("page_id").orderBy("at"))
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("at")).cast("long")
    return heads.select("page_id", place.alias("place"), "level", "heading", F.when(F.col("level") == 3, above).alias("parent"))


TOC_OUTLINE = r"""WITH own AS (SELECT page_id, unnest([0, 1, 2, 3, 4]) AS pos, unnest([2, 3, 3, 2, 3]) AS level, unnest(['First', 'Sub ' || page_id, 'After', 'Last', 'Kept']) AS heading FROM pages),
page AS (SELECT page_id, 10 + unnest(range(len(h))) AS pos, unnest(h) AS raw FROM (SELECT page_id, regexp_extract_all(html, '(?is)<h[23][^>]*>.*?</h[23]>') AS h FROM pages)),
every AS (SELECT * FROM own UNION ALL SELECT page_id, pos, substr(raw, 3, 1)::INT, trim(regexp_replace(regexp_replace(raw, '(?is)^<h[23][^>]*>', ''), '(?is)</h[23]>$', '')) FROM page)
SELECT page_id, row_number() OVER w AS place, level::BIGINT AS level, heading, CASE WHEN level = 3 THEN last_value(CASE WHEN level = 2 THEN heading END IGNORE NULLS) OVER w END AS parent FROM every WINDOW w AS (PARTITION BY page_id ORDER BY pos)"""


def post_urls(spark, d):
    """The address of a page from its file's path: the site and the folder, with a slash."""
    path = F.concat(F.lit("blog/"), (F.col("page_id") % 30 + 1990).cast("string"), F.lit("/p"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 5 > 0, "/index.html").otherwise("/notes.html"))
    folder = F.expr("substr(path, 1, length(path) - instr(reverse(path), '/') + 1)")
    return load(spark, d, "pages").select("page_id", path.alias("path")).select("page_id", F.concat(F.lit("https://site.example/"), folder).alias("url"))


def range_step(spark, d):
    stop = F.timestamp_add("HOUR", F.col("event_id").cast("int") % 9, F.col("ts").cast("timestamp"))
    at = Interval("hour").range(F.col("ts"), stop, 3)
    return load(spark, d, "events").select("event_id", F.size(at).cast("long").alias("n"), F.date_format(F.element_at(F.concat(at, F.array(F.lit(None).cast("timestamp"))), F.greatest(F.size(at), F.lit(1))), "yyyy-MM-dd HH:mm:ss").alias("last"))


RANGE_STEP = """WITH r AS (SELECT event_id, date_trunc('hour', date_trunc('millisecond', ts) - INTERVAL 1 MILLISECOND) + INTERVAL 1 HOUR AS a, date_trunc('hour', date_trunc('millisecond', ts) + to_hours((event_id % 9)::INT) - INTERVAL 1 MILLISECOND) + INTERVAL 1 HOUR AS b FROM events), l AS (SELECT event_id, range(a, b, INTERVAL 3 HOUR) AS pos FROM r)
SELECT event_id, len(pos) AS n, strftime(pos[len(pos)], '%Y-%m-%d %H:%M:%S') AS last FROM l"""


def interval_filter(spark, d):
    """The latest Sunday or Wednesday at or before a day."""
    day = Interval("day").floor_where(F.col("o_orderdate"), lambda t: F.dayofweek(t).isin(1, 4), 7)
    return load(spark, d, "orders").select("o_orderkey", F.date_format(day, "yyyy-MM-dd").alias("day"))


INTERVAL_FILTER = "SELECT o_orderkey, strftime(date_trunc('day', o_orderdate) - to_days(CASE dayofweek(o_orderdate) WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 0 WHEN 4 THEN 1 WHEN 5 THEN 2 ELSE 3 END), '%Y-%m-%d') AS day FROM orders"


def nan_order(spark, d):
    """Ascending numbers; what compares with nothing comes after them, missing values last."""
    x = F.when(F.col("c_custkey") % 7 == 0, F.lit(float("nan"))).when(F.col("c_custkey") % 11 > 0, F.col("c_acctbal"))
    rows = load(spark, d, "customer").select("c_custkey", "c_nationkey", x.alias("x"))
    w = Window.partitionBy("c_nationkey").orderBy(F.asc_nulls_last(F.when(~F.isnan("x"), F.col("x"))), F.col("x").isNull(), "c_custkey")
    return rows.select("c_custkey", F.row_number().over(w).cast("long").alias("place"))


NAN_ORDER = "SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN c_custkey % 7 > 0 AND c_custkey % 11 > 0 THEN c_acctbal END ASC NULLS LAST, c_custkey % 7 > 0, c_custkey) AS place FROM customer"


def partial_dates(spark, d):
    """Texts of a year, a month or a day, with what they state; empty ones state nothing."""
    text = F.element_at(F.array(F.lit(""), F.date_format("o_orderdate", "yyyy"), F.date_format("o_orderdate", "yyyy-MM"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("soon")), (F.col("o_orderkey") % 5 + 1).cast("int"))
    parts = F.split("text", "-")
    kind = F.when(F.col("text").rlike("^[0-9]{4}(-[0-9]{2}){0,2}$"), F.element_at(F.array(*map(F.lit, ("year", "month", "day"))), F.size(parts)))
    first = F.concat_ws("-", F.get(parts, F.lit(0)), F.coalesce(F.get(parts, F.lit(1)), F.lit("01")), F.coalesce(F.get(parts, F.lit(2)), F.lit("01"))).try_cast("date")
    return load(spark, d, "orders").select("o_orderkey", text.alias("text")).select("o_orderkey", kind.alias("precision"), F.when(kind.isNotNull(), F.date_format(first, "yyyy-MM-dd")).alias("first_day"))


PARTIAL_DATES = """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 1 THEN 'year' WHEN 2 THEN 'month' WHEN 3 THEN 'day' END AS precision, CASE o_orderkey % 5 WHEN 1 THEN strftime(o_orderdate, '%Y-01-01') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-01') WHEN 3 THEN strftime(o_orderdate, '%Y-%m-%d') END AS first_day FROM orders"""


def local_numerals(spark, d):
    """Numbers padded with zeros, and with the digits of another script."""
    shown = F.lpad(F.col("p_partkey").cast("string"), 8, "0")
    return load(spark, d, "part").select("p_partkey", shown.alias("padded"), F.translate(shown, "0123456789", "٠١٢٣٤٥٦٧٨٩").alias("numerals"))


def map_points(spark, d):
    """Mercator points as the text of a path, and a scale read backwards."""
    p = scales.mercator(F.col("c_custkey") % 360 - 180.0, F.col("c_custkey") % 160 - 80.0, 100.0)
    point = lambda c: F.format_string("%.0f,%.0f", F.floor(c["x"] + 0.5).cast("double"), F.floor(c["y"] + 0.5).cast("double"))
    back = scales.invert(scales.linear(F.col("c_acctbal"), (0, 10_000), (5, -5)), (0, 10_000), (5, -5))
    return load(spark, d, "customer").select("c_custkey", "c_acctbal", p.alias("p")).select("c_custkey", F.array_join(F.transform(F.array("p", F.struct(F.lit(0.0).alias("x"), F.lit(1.0).alias("y"))), point), " ").alias("points"), (F.floor(back * 100 + 0.5) / 100).alias("back"))


MAP_POINTS = "SELECT c_custkey, printf('%.0f,%.0f 0,1', floor(radians(c_custkey % 360 - 180) * 100 + 0.5) + 0.0, floor(-ln(tan(pi() / 4 + radians(c_custkey % 160 - 80) / 2)) * 100 + 0.5) + 0.0) AS points, floor(c_acctbal * 100 + 0.5) / 100 AS back FROM customer"


def money_formats(spark, d):
    """Groups of other sizes and other currencies."""
    x = F.col("o_totalprice") * 1000
    return load(spark, d, "orders").select("o_orderkey", numfmt.format_number(x, "$,.0f", (3, 2), ("", " EUR")).alias("shown"))


MONEY = """WITH t AS (SELECT o_orderkey, floor(o_totalprice * 1000 + 0.5)::BIGINT::VARCHAR AS n FROM orders), h AS (SELECT *, reverse(n[1:length(n) - 3]) AS head FROM t)
SELECT o_orderkey, CASE WHEN length(n) <= 3 THEN n ELSE reverse(array_to_string(list_transform(range(0, (length(head) + 1) // 2), lambda i: substr(head, i * 2 + 1, 2)), ',')) || ',' || right(n, 3) END || ' EUR' AS shown FROM h"""


def math_candidates(spark, d):
    """Only texts with a delimiter go on to the costly parse."""
    marks = F.array(*map(F.lit, ("$", "**", "http")))
    return load(spark, d, "documents").filter(F.exists(marks, lambda m: F.contains(F.col("text"), m))).select("doc_id")


def keyed_store(spark, d):
    """Stores without removals: each element keeps its first key, sets of other keys are refused (with removals: keyed_log)."""
    e = load(spark, d, "events").select((F.col("user_id") % 40).alias("element"), "event_id", F.col("event_type").alias("key"), "value")
    first = e.groupBy("element").agg(F.min_by("key", "event_id").alias("held"))
    return e.join(first, "element").groupBy("element", "held").agg(F.max_by(F.when(F.col("key") == F.col("held"), F.col("event_id")), F.when(F.col("key") == F.col("held"), F.col("event_id"))).alias("last"), F.count_if(F.col("key") != F.col("held")).alias("refused"))


KEYED_STORE = """WITH e AS (SELECT user_id % 40 AS element, event_id, event_type FROM events), f AS (SELECT element, arg_min(event_type, event_id) AS held FROM e GROUP BY 1)
SELECT element, held, max(event_id) FILTER (event_type = held) AS last, count(*) FILTER (event_type <> held) AS refused FROM e JOIN f USING (element) GROUP BY ALL"""

QUERIES = {
    "author_links": (author_links, AUTHOR_LINKS),
    "source_union": (source_union, "SELECT page_id, url, 'feed' AS source FROM pages WHERE page_id % 4 < 2 UNION ALL SELECT page_id, url, 'posts' FROM pages WHERE page_id % 3 = 0"),
    "selected_papers": (selected_papers, "SELECT doc_id, lang FROM documents JOIN labels USING (doc_id) WHERE quality = 1"),
    "toc_outline": (toc_outline, TOC_OUTLINE),
    "post_urls": (post_urls, "SELECT page_id, 'https://site.example/blog/' || (page_id % 30 + 1990) || '/p' || page_id || '/' AS url FROM pages"),
    "range_step": (range_step, RANGE_STEP),
    "interval_filter": (interval_filter, INTERVAL_FILTER),
    "nan_order": (nan_order, NAN_ORDER),
    "partial_dates": (partial_dates, PARTIAL_DATES),
    "local_numerals": (local_numerals, "SELECT p_partkey, lpad(p_partkey::VARCHAR, 8, '0') AS padded, translate(lpad(p_partkey::VARCHAR, 8, '0'), '0123456789', '٠١٢٣٤٥٦٧٨٩') AS numerals FROM part"),
    "map_points": (map_points, MAP_POINTS),
    "money_formats": (money_formats, MONEY),
    "math_candidates": (math_candidates, "SELECT doc_id FROM documents WHERE contains(text, '$') OR contains(text, '**') OR contains(text, 'http')"),
    "keyed_store": (keyed_store, KEYED_STORE),
}
