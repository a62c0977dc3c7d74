"""Queries over sources and sinks, and over record rules: feeds, YAML records, types, names, orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import records, text
from ..operators import datajoin, feed, positional
from ..sources import external, tables, yaml_text
from ..sources.tables import load
from .join_queries import _SIDES, _two_sides
from .text_queries import _POSTS_SQL, _posts


def feed_roundtrip(spark, d):
    """The feed is written over many files and read back as items."""
    path = tables.scratch_folder(spark, "feed")
    feed.render(feed.items(_posts(spark, d), whole=True), "All", path)
    return tables.rss_items(spark, path, "title string, link string, pubDate string", trim=False).withColumnRenamed("pubDate", "pub_date")


FEED_ROUNDTRIP = f"SELECT title, link, strftime(pub_date, '%a, %d %b %Y %H:%M:%S') || ' +0000' AS pub_date FROM {_POSTS_SQL}"


def feed_file_lines(spark, d):
    """Whole feed files as texts: lines and items over all of them."""
    path = tables.scratch_folder(spark, "feed")
    feed.render(feed.items(_posts(spark, d), whole=True), "All", path)
    lines = F.filter(F.split("text", "\n"), lambda s: s != "")
    return tables.text_files(spark, f"{path}/part-*").agg(F.sum(F.size(lines)).cast("long").alias("lines"), F.sum(F.size(F.filter(lines, lambda s: s.startswith("<item>")))).cast("long").alias("items"))


def json_lists(spark, d):
    """Events written as documents of up to a thousand records each, and read back."""
    path = tables.scratch_folder(spark, "json")
    record = F.struct("event_id", F.struct("event_type", "props").alias("what"))
    rows = load(spark, d, "events").groupBy(F.floor(F.col("event_id") / 1000).alias("part")).agg(F.to_json(F.collect_list(record)).alias("value"))
    rows.write.partitionBy("part").text(path)
    found = tables.json_documents(spark, path, "event_id long, what struct<event_type: string, props: string>")
    return found.select("event_id", "what.event_type", F.get_json_object("what.props", "$.k").cast("long").alias("k"))


def written_once(spark, d):
    """A target that is there already is left as it is."""
    rows = load(spark, d, "customer").select("c_custkey", "c_nationkey")
    path = tables.scratch_folder(spark, "once") + "/kept"
    tables.write_once(rows.filter("c_nationkey % 2 = 0"), path)
    tables.write_once(rows, path)
    return spark.read.parquet(path)


def yaml_values(spark, d):
    """A record of two fields and a list of two records for each nation."""
    key = F.col("n_nationkey").cast("string")
    lines = ["# venues", F.concat(F.lit('"'), "n_name", F.lit(' v":')), F.concat(F.lit("  url: https://venue.example/"), key), F.concat(F.lit('  color: "#00'), key, F.lit('"  # mark')), "", "people:", F.concat(F.lit('  - firstname: ["Ann", "A."]')), F.concat(F.lit("    url: /a"), key), F.concat(F.lit("  - url: '/b"), key, F.lit("'"))]
    body = F.concat_ws("\n", *(F.lit(x) if isinstance(x, str) else x for x in lines))
    found = tables.yaml_records(load(spark, d, "nation").select("n_nationkey", body.alias("body")), "n_nationkey", "body")
    return found.select("n_nationkey", "name", "item", "field", "value")


YAML_VALUES = """SELECT n_nationkey, n_name || ' v' AS name, 0::BIGINT AS item, 'url' AS field, 'https://venue.example/' || n_nationkey AS value FROM nation
UNION ALL SELECT n_nationkey, n_name || ' v', 0, 'color', '#00' || n_nationkey FROM nation
UNION ALL SELECT n_nationkey, 'people', 1, 'firstname', '["Ann", "A."]' FROM nation
UNION ALL SELECT n_nationkey, 'people', 1, 'url', '/a' || n_nationkey FROM nation
UNION ALL SELECT n_nationkey, 'people', 2, 'url', '/b' || n_nationkey FROM nation"""


def yaml_paths(spark, d):
    """Lists in lists, named lists, scalars of all kinds and blocks, from the parts."""
    n = F.col("p_partkey").cast("string")
    lines = ["---", "lines_max: 2  # most", "users:", F.concat(F.lit("- u"), n), '- "v: x"', "", "cv:", "  - title: General", "    contents:", F.concat(F.lit("      - name: "), "p_name"), F.concat(F.lit("        value: #"), "p_brand"), "      - - a", F.concat(F.lit("        - 'b "), n, F.lit("'")), "  - title: Rest", "    tags: [x, 'y, z', 3]", "    note: >", F.concat(F.lit("      one "), n), "      two", "", "      three # no comment", "    text: |", "      l1", "       l2", "    long: goes", "      on", "last:", "  a:", "    b:", F.concat(F.lit("      c: http://x/"), n)]
    body = F.concat_ws("\n", *(F.lit(x) if isinstance(x, str) else x for x in lines))
    parts = tables.spread(load(spark, d, "part").select("p_partkey", "p_name", "p_brand"))
    found = yaml_text.yaml_paths(parts.select("p_partkey", body.alias("body")), "p_partkey", "body")
    return found.select("p_partkey", F.col("place").cast("long").alias("place"), "path", "value")


YAML_PATHS = """SELECT p_partkey, unnest(range(15)) AS place, unnest(['lines_max', 'users[0]', 'users[1]', 'cv[0].title', 'cv[0].contents[0].name', 'cv[0].contents[1][0]', 'cv[0].contents[1][1]', 'cv[1].title', 'cv[1].tags[0]', 'cv[1].tags[1]', 'cv[1].tags[2]', 'cv[1].note', 'cv[1].text', 'cv[1].long', 'last.a.b.c']) AS path,
unnest(['2', 'u' || p_partkey, 'v: x', 'General', p_name, 'a', 'b ' || p_partkey, 'Rest', 'x', 'y, z', '3', 'one ' || p_partkey || ' two' || chr(10) || 'three # no comment', 'l1' || chr(10) || ' l2', 'goes on', 'http://x/' || p_partkey]) AS value FROM part"""


def source_dispatch(spark, d):
    """Posts of four sources: feeds that are read, posts that are listed, and one source of neither kind."""
    path = tables.scratch_folder(spark, "feed")
    feed.render(feed.items(_posts(spark, d), whole=True), "All", path)
    pages = load(spark, d, "pages")
    named = lambda name, title: pages.select(F.lit(name).alias("source"), title.alias("title"), F.col("url").alias("link"), F.lit("2025-01-01").alias("published"))
    listed = named("list", F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("t"), F.col("page_id").cast("string")))).unionByName(named("both", F.lit("x"))).unionByName(named("other", F.lit("y")))
    sources = [external.Source("feed", path, trim=False), external.Source("both", path, True, trim=False), external.Source("list", None, True), external.Source("none")]
    return external.posts(sources, listed)


SOURCE_DISPATCH = f"""WITH p AS (SELECT title, link, strftime(pub_date, '%a, %d %b %Y %H:%M:%S') || ' +0000' AS published FROM {_POSTS_SQL})
SELECT 'feed' AS source, title, link, published FROM p UNION ALL SELECT 'both', title, link, published FROM p UNION ALL SELECT 'list', CASE WHEN page_id % 2 = 0 THEN 't' || page_id ELSE url END, url, '2025-01-01' FROM pages"""


def config_types(spark, d):
    """How many settings of each name have which type, and whether their rule allows it."""
    e = load(spark, d, "events").select(F.col("user_id").alias("offset"), F.when(F.col("event_id") % 3 > 0, F.col("event_type")).alias("method"), F.when(F.col("event_id") % 4 > 0, F.col("value")).alias("delay"))
    checks = records.type_checks({"offset": "^(bigint|string)$", "method": "^(string|null)$", "delay": "^(double|decimal.*)$"})
    return e.select(F.explode(checks).alias("c")).groupBy("c.name", "c.kind", "c.ok").agg(F.count("*").alias("n"))


CONFIG_TYPES = """WITH c AS (SELECT 'offset' AS name, 'bigint' AS kind, true AS ok FROM events UNION ALL SELECT 'method', CASE WHEN event_id % 3 > 0 THEN 'string' ELSE 'null' END, true FROM events
UNION ALL SELECT 'delay', CASE WHEN event_id % 4 > 0 THEN 'double' ELSE 'null' END, event_id % 4 > 0 FROM events) SELECT name, kind, ok, count(*) AS n FROM c GROUP BY ALL"""

_NAMES = ("J.P.", "J+P", "Jo|Al", "(X)")


def name_places(spark, d):
    """The place of the listed name that a text begins with, whatever its case; names are read as they stand."""
    start = F.element_at(F.array(*map(F.lit, (*_NAMES, "JXPX", "Jo", "jo|AL"))), (F.col("p_partkey") % 7 + 1).cast("int"))
    return load(spark, d, "part").select("p_partkey", text.name_place(F.concat(start, F.lit(" "), F.col("p_name")), _NAMES).cast("long").alias("place"))


NAME_PLACES = "SELECT p_partkey, CASE p_partkey % 7 WHEN 4 THEN NULL WHEN 5 THEN NULL WHEN 6 THEN 2 ELSE p_partkey % 7 END AS place FROM part"


def bind_order(spark, d):
    """What a data join leaves, numbered in the order of the data."""
    nodes, data = _two_sides(spark, d)
    return datajoin.bind_order(datajoin.joined(datajoin.keyed(nodes, data, "k", "pos", "v", "grp")), "grp").select("grp", "data_order", F.col("place").cast("long").alias("place"))


def cite_numbers_untrimmed(spark, d):
    """As cite_numbers, with keys as they stand between the commas."""
    e = load(spark, d, "events").select((F.col("user_id") % 50).alias("doc"), "event_id", F.concat_ws(", ", F.concat(F.lit("k"), (F.col("event_id") % 11).cast("string")), F.concat(F.lit("k"), (F.col("user_id") % 7).cast("string"))).alias("keys"))
    return positional.collected_keys(e, "doc", "event_id", "keys", trim=False).withColumn("number", F.col("number").cast("long"))


UNTRIMMED = """WITH k AS (SELECT user_id % 50 AS doc, event_id, 'k' || event_id % 11 AS key, 0 AS p FROM events UNION ALL SELECT user_id % 50, event_id, ' k' || user_id % 7, 1 FROM events),
f AS (SELECT doc, key, min(event_id * 2 + p) AS first FROM k GROUP BY ALL) SELECT doc, key, row_number() OVER (PARTITION BY doc ORDER BY first) - 1 AS number FROM f"""


def doc_search_empty(spark, d):
    """An empty term filters nothing."""
    return load(spark, d, "documents").filter(text.contains_term(F.col("text"), "")).select("doc_id", "lang")


QUERIES = {
    "feed_roundtrip": (feed_roundtrip, FEED_ROUNDTRIP),
    "feed_file_lines": (feed_file_lines, f"SELECT count(*) + 2 AS lines, count(*) AS items FROM {_POSTS_SQL}"),
    "json_lists": (json_lists, "SELECT event_id, event_type, (props::JSON->>'$.k')::BIGINT AS k FROM events"),
    "written_once": (written_once, "SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey % 2 = 0"),
    "yaml_values": (yaml_values, YAML_VALUES),
    "yaml_paths": (yaml_paths, YAML_PATHS),
    "source_dispatch": (source_dispatch, SOURCE_DISPATCH),
    "config_types": (config_types, CONFIG_TYPES),
    "name_places": (name_places, NAME_PLACES),
    "bind_order": (bind_order, f"WITH {_SIDES} SELECT grp, pos AS data_order, row_number() OVER (PARTITION BY grp ORDER BY pos) - 1 AS place FROM d0"),
    "cite_numbers_untrimmed": (cite_numbers_untrimmed, UNTRIMMED),
    "doc_search_empty": (doc_search_empty, "SELECT doc_id, lang FROM documents"),
}
