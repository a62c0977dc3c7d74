"""Queries over records, configuration, hierarchies and selections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import numfmt, records
from ..operators import positional
from ..sources.tables import load


def _key():
    return F.col("o_orderkey")


def setting_default(spark, d):
    raw = F.element_at(F.array(F.lit("dark"), F.lit("LIGHT"), F.lit("light"), F.lit(None)), (F.col("event_id") % 4 + 1).cast("int"))
    return load(spark, d, "events").select("event_id", records.setting(raw, ("dark", "light", "system"), "system").alias("theme"))


def venue_lines(spark, d):
    part = lambda m, text: F.when(_key() % m > 0, F.lit(text))
    return load(spark, d, "orders").select("o_orderkey", records.venue_line(part(2, "12"), part(3, "4"), part(5, "1-9"), part(7, "Press")).alias("line"))


VENUE_LINES = """SELECT o_orderkey, concat_ws('. ', concat_ws(', ', nullif((CASE WHEN o_orderkey % 2 > 0 THEN '12' ELSE '' END) || (CASE WHEN o_orderkey % 3 > 0 THEN '(4)' ELSE '' END), ''), CASE WHEN o_orderkey % 5 > 0 THEN '1-9' END), CASE WHEN o_orderkey % 7 > 0 THEN 'Press' END) AS line FROM orders"""


def paper_links(spark, d):
    url = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://arxiv.org/abs/"), F.col("page_id").cast("string"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("/x"), F.col("page_id").cast("string"), F.lit(".html"))).otherwise(F.col("url"))
    doi = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("https://dx.doi.org/10.1/"), F.col("page_id").cast("string"))).otherwise(F.lit("10.1/x"))
    return load(spark, d, "pages").select("page_id", records.paper_link(url).alias("l"), records.doi_link(doi).alias("doi")).select("page_id", "l.label", "l.href", "doi")


PAPER_LINKS = """WITH u AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'https://arxiv.org/pdf/' || page_id || '.pdf' WHEN 1 THEN '/x' || page_id || '.html' ELSE url END AS href FROM pages)
SELECT page_id, CASE WHEN href LIKE '%.pdf' THEN 'PDF' WHEN href LIKE '%.html' THEN 'HTML' ELSE 'link' END AS label, href, 'https://doi.org/10.1/' || CASE WHEN page_id % 2 = 0 THEN page_id::VARCHAR ELSE 'x' END AS doi FROM u"""


def periodicals(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ("article", "inproceedings", "thesis", "misc"))), (_key() % 4 + 1).cast("int"))
    line = records.periodical(kind, F.col("o_orderpriority"), F.col("o_orderstatus"), F.date_format("o_orderdate", "MMM"), F.year("o_orderdate"))
    return load(spark, d, "orders").select("o_orderkey", line.alias("line"))


PERIODICALS = """SELECT o_orderkey, concat_ws(', ', CASE o_orderkey % 4 WHEN 0 THEN 'In ' || o_orderpriority WHEN 1 THEN 'In ' || o_orderstatus WHEN 2 THEN 'Thesis' END, strftime(o_orderdate, '%b %Y')) AS line FROM orders"""


def bibtex_text(spark, d):
    tags = F.map_from_arrays(F.array(F.lit("year"), F.lit("title")), F.array((F.col("n_nationkey") + 1990).cast("string"), F.col("n_name")))
    return load(spark, d, "nation").select("n_nationkey", records.bibtex(F.lit("misc"), F.concat(F.lit("k"), F.col("n_nationkey").cast("string")), tags).alias("bibtex"))


BIBTEX_TEXT = "SELECT n_nationkey, '@misc{k' || n_nationkey || ',' || chr(10) || '  title = {' || n_name || '},' || chr(10) || '  year = {' || (n_nationkey + 1990) || '}' || chr(10) || '}' AS bibtex FROM nation"


def version_urls(spark, d):
    urls = F.create_map(F.lit("css"), F.lit("https://c/{{version}}/a.css"), F.lit("js"), F.concat(F.lit("https://c/a@{{version}}?"), F.col("r_name")))
    return load(spark, d, "region").select("r_regionkey", F.explode(records.substituted(urls, F.concat(F.lit("4."), F.col("r_regionkey").cast("string")))).alias("kind", "url"))


VERSION_URLS = "SELECT r_regionkey, 'css' AS kind, 'https://c/4.' || r_regionkey || '/a.css' AS url FROM region UNION ALL SELECT r_regionkey, 'js', 'https://c/a@4.' || r_regionkey || '?' || r_name FROM region"


def nested_or_scalar(spark, d):
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"url": "/a'), F.col("event_id").cast("string"), F.lit('"}'))).when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"url": {"x": "/b", "y": "/c'), F.col("event_id").cast("string"), F.lit('"}}'))).otherwise(F.lit("{}"))
    return load(spark, d, "events").select("event_id", F.explode(records.url_of(raw, "url")).alias("url"))


NESTED = """SELECT event_id, '/a' || event_id AS url FROM events WHERE event_id % 3 = 0 UNION ALL SELECT event_id, '/b' FROM events WHERE event_id % 3 = 1 UNION ALL SELECT event_id, '/c' || event_id FROM events WHERE event_id % 3 = 1"""


def json_deep_path(spark, d):
    raw = F.concat(F.lit('{"hits": {"hits": [{"metadata": {"citation_count": '), F.when(F.col("event_id") % 5 == 0, F.lit('"none"')).otherwise(F.col("event_id").cast("string")), F.lit("}}]}}"))
    return load(spark, d, "events").select("event_id", F.get_json_object(raw, "$.hits.hits[0].metadata.citation_count").try_cast("bigint").alias("cited"))


def migrated_affiliations(spark, d):
    many = F.when(F.col("s_suppkey") % 3 == 0, F.array(F.struct(F.col("s_name").alias("name"), F.lit("/u").alias("url")))).when(F.col("s_suppkey") % 3 == 1, F.array().cast("array<struct<name string, url string>>"))
    out = records.affiliations(many, F.when(F.col("s_suppkey") % 2 == 0, F.lit("Lab")), F.lit("/lab"))
    return load(spark, d, "supplier").select("s_suppkey", F.coalesce(F.size(out), F.lit(-1)).cast("long").alias("n"), F.get(out, F.lit(0))["name"].alias("first"))


MIGRATED = "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 1 WHEN s_suppkey % 3 = 1 THEN 0 WHEN s_suppkey % 2 = 0 THEN 1 ELSE -1 END::BIGINT AS n, CASE WHEN s_suppkey % 3 = 0 THEN s_name WHEN s_suppkey % 3 = 2 AND s_suppkey % 2 = 0 THEN 'Lab' END AS first FROM supplier"


def typed_dates(spark, d):
    text = F.when(_key() % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(_key() % 3 == 1, F.lit("soon"))
    return load(spark, d, "orders").select("o_orderkey", F.date_format(records.published(text, F.when(_key() % 3 == 2, F.col("o_orderdate"))), "yyyy-MM-dd").alias("day"))


def splice(spark, d):
    roles = load(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("r"))
    return roles.select("conv_id", F.array_join(records.without_at(F.col("r"), F.lit(1)), ",").alias("rest"), F.array_join(F.slice("r", F.lit(2), F.greatest(F.size("r") - 2, F.lit(0))), ",").alias("inner"))


SPLICE = "SELECT conv_id, array_to_string(r[1:1] || r[3:], ',') AS rest, array_to_string(r[2:len(r) - 1], ',') AS inner FROM (SELECT conv_id, list(role ORDER BY turn, role) AS r FROM conversations GROUP BY 1)"


def edge_flags(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn", "role")
    return load(spark, d, "conversations").select("conv_id", "turn", F.lag("turn").over(w).isNull().alias("first"), F.lead("turn").over(w).isNull().alias("last"), F.count("*").over(Window.partitionBy("conv_id")).alias("length"))


EDGE_FLAGS = "SELECT conv_id, turn, lag(turn) OVER w IS NULL AS first, lead(turn) OVER w IS NULL AS last, count(*) OVER (PARTITION BY conv_id) AS length FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role)"


def preceding_heading(spark, d):
    """The closest earlier row of a kind, as of a list's heading."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role").rowsBetween(Window.unboundedPreceding, -1)
    return load(spark, d, "conversations").select("conv_id", "turn", F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(w).alias("heading"))


PRECEDING = "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, role ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS heading FROM conversations"


def map_folding(spark, d):
    tags = load(spark, d, "events").groupBy((F.col("user_id") % 50).alias("k")).agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("event_type", F.length("event_type").alias("n"))))).alias("m"))
    return tags.select("k", F.explode(F.map_entries("m")).alias("e")).select("k", F.col("e")["key"].alias("name"), F.col("e")["value"].cast("long").alias("n"))


def grid_size(spark, d):
    lines = load(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.max(F.length("line")).cast("long").alias("width"), F.count("*").alias("height"))


def glyph_classes(spark, d):
    """Letters beside letters are text, lone ones glyphs; v is always a glyph."""
    rows = load(spark, d, "documents").select("doc_id", positional.glyph_counts(F.col("text")).alias("n"))
    kinds = rows.groupBy("doc_id").agg(*(F.sum(f"n.{k}").alias(k) for k in ("text", "space", "glyph")))
    return kinds.unpivot("doc_id", ["text", "space", "glyph"], "kind", "n").filter("n > 0")


GLYPHS = """WITH y AS (SELECT doc_id, y, unnest(range(len(lines))) AS no, unnest(lines) AS line FROM (SELECT doc_id, 0 AS y, string_split(text, chr(10)) AS lines FROM documents)),
g AS (SELECT doc_id, no, unnest(range(length(line))) AS x, unnest(string_split(line, '')) AS ch FROM y WHERE line <> ''),
k AS (SELECT doc_id, ch, regexp_matches(coalesce(lag(ch) OVER w, ' '), '^[a-zA-Z]$') OR regexp_matches(coalesce(lead(ch) OVER w, ' '), '^[a-zA-Z]$') AS near FROM g WINDOW w AS (PARTITION BY doc_id, no ORDER BY x))
SELECT doc_id, CASE WHEN regexp_matches(ch, '^[a-uw-zA-Z]$') AND near THEN 'text' WHEN ch = ' ' THEN 'space' ELSE 'glyph' END AS kind, count(*) AS n FROM k GROUP BY ALL"""


def drag_rotation(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    turn = F.sum(F.floor(F.col("value") * 100)).over(w) * 75 / 250 / 100
    return load(spark, d, "events").select("event_id", (F.floor(turn * 1e6 + 0.5) / 1e6).alias("rotation"))


DRAG = "SELECT event_id, floor(sum(floor(value * 100)) OVER (PARTITION BY user_id ORDER BY ts, event_id) * 75 / 250 / 100 * 1e6::DOUBLE + 0.5) / 1e6::DOUBLE AS rotation FROM events"


def beam_points(spark, d):
    r = F.greatest(F.lit(3.0), F.col("p_size") / 2)
    x, y = F.col("p_partkey") % 100, F.col("p_size")
    return load(spark, d, "part").select("p_partkey", F.concat_ws(" ", *(F.format_string("%.1f,%.1f", (x + dx * r).cast("double"), (y + dy * r).cast("double")) for dx, dy in ((-1, 0), (1, 0), (2, -4), (-2, -4)))).alias("points"))


BEAM = "SELECT p_partkey, concat_ws(' ', " + ", ".join(f"printf('%.1f,%.1f', p_partkey % 100 + {dx} * r, p_size + {dy} * r)" for dx, dy in ((-1, 0), (1, 0), (2, -4), (-2, -4))) + ") AS points FROM (SELECT *, greatest(3.0::DOUBLE, p_size / 2::DOUBLE) AS r FROM part)"


def format_precision(spark, d):
    step = F.pow(F.lit(10.0), (F.col("p_size") % 7 - 4).cast("double"))
    return load(spark, d, "part").select("p_partkey", numfmt.precision_fixed(step).cast("long").alias("fixed"), numfmt.precision_round(step, F.col("p_retailprice")).cast("long").alias("round"))


PRECISION = "SELECT p_partkey, greatest(0, 4 - p_size % 7)::BIGINT AS fixed, (greatest(0, floor(log10(p_retailprice - pow(10::DOUBLE, p_size % 7 - 4)) + 1e-12) - (p_size % 7 - 4)) + 1)::BIGINT AS round FROM part"


def gated_pairs(spark, d):
    docs, labels = load(spark, d, "documents").select("doc_id", "lang"), load(spark, d, "labels").filter("quality = 1").select("doc_id")
    return docs.join(labels, "doc_id").groupBy("lang").agg(F.count("*").alias("ready"))


def layout_dispatch(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ("bootstrap", "custom", "other"))), (F.col("conv_id") % 3 + 1).cast("int"))
    rows = load(spark, d, "conversations").withColumn("kind", kind)
    plain = rows.filter("kind = 'bootstrap'").select("conv_id", "turn", F.concat_ws("|", "role", F.md5("text")).alias("row"))
    return plain.unionByName(rows.filter("kind = 'custom'").select("conv_id", "turn", F.concat_ws("|", F.md5("text"), "role", F.col("turn").cast("string")).alias("row")))


LAYOUT = "SELECT conv_id, turn, CASE conv_id % 3 WHEN 0 THEN role || '|' || md5(text) ELSE md5(text) || '|' || role || '|' || turn END AS row FROM conversations WHERE conv_id % 3 < 2"

QUERIES = {
    "setting_default": (setting_default, "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'dark' WHEN 2 THEN 'light' ELSE 'system' END AS theme FROM events"),
    "venue_lines": (venue_lines, VENUE_LINES),
    "paper_links": (paper_links, PAPER_LINKS),
    "periodicals": (periodicals, PERIODICALS),
    "bibtex_text": (bibtex_text, BIBTEX_TEXT),
    "version_urls": (version_urls, VERSION_URLS),
    "nested_or_scalar": (nested_or_scalar, NESTED),
    "json_deep_path": (json_deep_path, "SELECT event_id, CASE WHEN event_id % 5 > 0 THEN event_id END AS cited FROM events"),
    "migrated_affiliations": (migrated_affiliations, MIGRATED),
    "typed_dates": (typed_dates, "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 1 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders"),
    "splice": (splice, SPLICE),
    "edge_flags": (edge_flags, EDGE_FLAGS),
    "preceding_heading": (preceding_heading, PRECEDING),
    "map_folding": (map_folding, "SELECT DISTINCT user_id % 50 AS k, event_type AS name, length(event_type) AS n FROM events"),
    "grid_size": (grid_size, "SELECT doc_id, max(length(line)) AS width, count(*) AS height FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY 1"),
    "glyph_classes": (glyph_classes, GLYPHS),
    "drag_rotation": (drag_rotation, DRAG),
    "beam_points": (beam_points, BEAM),
    "format_precision": (format_precision, PRECISION),
    "gated_pairs": (gated_pairs, "SELECT lang, count(*) AS ready FROM documents JOIN labels USING (doc_id) WHERE quality = 1 GROUP BY lang"),
    "layout_dispatch": (layout_dispatch, LAYOUT),
}
