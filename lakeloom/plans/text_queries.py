"""Queries over text, pages and feeds, each with the same question in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import feed, memo
from ..sources.tables import load

_ACCENTS, _BASES = text.accent_map()
_TITLE = r"regexp_extract(html, '(?is)<title>(.*?)</title>', 1)"


def _unescaped(x: str) -> str:
    return f"replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#x27;', ''''), '&amp;', '&')"


def _escaped(x: str) -> str:
    return f"replace(replace(replace(replace(replace({x}, '&', '&amp;'), '''', '&#x27;'), '\"', '&quot;'), '>', '&gt;'), '<', '&lt;')"


def _posts(spark, d):
    when = F.timestamp_add("DAY", (F.col("page_id") % 17).cast("int"), F.lit("2025-01-01").cast("timestamp"))
    return feed.posts(load(spark, d, "pages"), "page_id", "html", F.col("url"), when)


_POSTS_SQL = f"""(SELECT page_id, {_unescaped(f"trim({_TITLE})")} AS title, url AS link,
  TIMESTAMP '2025-01-01' + to_days((page_id % 17)::INT) AS pub_date FROM pages WHERE trim({_TITLE}) <> '')"""


def feed_items(spark, d):
    return feed.items(_posts(spark, d)).select("page_id", "rank", "title", "link", "xml")


FEED_ITEMS = f"""SELECT page_id, row_number() OVER (ORDER BY pub_date DESC, link) AS rank, title, link,
  '<item><title>' || {_escaped("title")} || '</title><link>' || {_escaped("link")} || '</link><pubDate>' ||
  strftime(pub_date, '%a, %d %b %Y %H:%M:%S') || ' +0000</pubDate><description></description></item>' AS xml FROM {_POSTS_SQL}"""


def feed_fallbacks(spark, d):
    """Pages with more and less in their heads: each branch of title, description, link, image and date is reached."""
    n, kind = F.col("page_id").cast("string"), F.col("page_id") % 5
    own = F.concat(F.lit('<meta property="og:title" content="OG &amp; '), n, F.lit('"><meta content="D '), n, F.lit('" property="og:description"><link rel="canonical" href="https://c/'), n, F.lit('"><meta property="og:image" content="i'), n, F.lit('.png">'))
    other = F.concat(F.lit("<meta name='description' content='N "), n, F.lit("'><meta property=\"og:url\" content=\"https://o/"), n, F.lit("\"><meta property='og:title' content=''>"))
    html = F.concat(F.when(kind == 0, own).when(kind == 1, other).when(kind == 2, F.concat(F.lit("<p>Created in May, "), (F.col("page_id") % 20 + 2000).cast("string"), F.lit("</p>"))).otherwise(""), F.col("html"))
    pages = load(spark, d, "pages").select("page_id", "url", html.alias("html"))
    found = feed.items(feed.posts(pages, "page_id", "html", F.col("url"), F.lit("2025-01-01").cast("timestamp")))
    return found.select("page_id", "title", "description", "link", F.date_format("pub_date", "yyyy-MM-dd").alias("day"), F.regexp_extract("xml", "<enclosure[^>]*>", 0).alias("enclosure"))


FEED_FALLBACKS = f"""SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'OG & ' || page_id ELSE {_unescaped(f"trim({_TITLE})")} END AS title, CASE page_id % 5 WHEN 0 THEN 'D ' || page_id WHEN 1 THEN 'N ' || page_id ELSE '' END AS description,
CASE page_id % 5 WHEN 0 THEN 'https://c/' || page_id WHEN 1 THEN 'https://o/' || page_id ELSE url END AS link, CASE WHEN page_id % 5 = 2 THEN (page_id % 20 + 2000) || '-05-01' ELSE '2025-01-01' END AS day,
CASE WHEN page_id % 5 = 0 THEN '<enclosure url="i' || page_id || '.png"/>' ELSE '' END AS enclosure FROM pages WHERE page_id % 5 = 0 OR trim({_TITLE}) <> ''"""


def feed_last_build(spark, d):
    return feed.last_build(_posts(spark, d), "2000-01-01")


FEED_LAST_BUILD = f"SELECT strftime(coalesce(max(pub_date), TIMESTAMP '2000-01-01'), '%a, %d %b %Y %H:%M:%S') || ' +0000' AS last_build FROM {_POSTS_SQL}"


def feed_stale_rows(spark, d):
    pages = load(spark, d, "pages").select("page_id", F.col("html").alias("body"))
    golden = pages.filter("page_id % 10 <> 3").withColumn("body", F.when(F.col("page_id") % 7 == 0, F.concat("body", F.lit("!"))).otherwise(F.concat(F.lit(" "), "body")))
    return feed.stale(pages.filter("page_id % 10 <> 4"), golden, "page_id", "body")


FEED_STALE = """SELECT page_id, CASE WHEN page_id % 10 = 3 THEN 'new' WHEN page_id % 10 = 4 THEN 'missing' ELSE 'changed' END AS state
FROM pages WHERE page_id % 10 IN (3, 4) OR page_id % 7 = 0"""


def doc_search(spark, d):
    return load(spark, d, "documents").filter(text.contains_term(F.col("text"), "Tion The")).select("doc_id", "lang")


def doc_search_node_scoped(spark, d):
    return load(spark, d, "pages").filter(text.node_contains_term(F.col("html"), "tion the")).select("page_id")


NODE_SEARCH = "SELECT page_id FROM pages WHERE len(list_filter(regexp_split_to_array(html, '<[^>]*>'), lambda s: contains(lower(s), 'tion the'))) > 0"


def highlight_ranges(spark, d):
    rows = text.occurrences(load(spark, d, "documents"), "doc_id", F.lower("text"), F.lit("tion"))
    return rows.select("doc_id", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"))


HIGHLIGHT = """WITH p AS (SELECT doc_id, string_split(lower(text), 'tion') AS parts FROM documents),
e AS (SELECT doc_id, unnest(range(1, len(parts))) AS i, parts FROM p)
SELECT doc_id, (list_sum(list_transform(parts[1:i], lambda s: length(s))) + (i - 1) * 4)::BIGINT AS start,
  (list_sum(list_transform(parts[1:i], lambda s: length(s))) + i * 4)::BIGINT AS stop FROM e"""


def group_hidden(spark, d):
    docs = load(spark, d, "documents")
    groups = docs.select("lang", "source").distinct().unionByName(spark.createDataFrame([("xx", "none")], "lang string, source string"))
    return memo.hidden_groups(docs, groups, text.contains_term(F.col("text"), "idiot"), "lang", "source")


GROUP_HIDDEN = """SELECT lang, source, NOT bool_or(contains(lower(text), 'idiot')) AS hidden FROM documents GROUP BY lang, source
UNION ALL SELECT 'xx', 'none', true"""


def group_hidden_two_levels(spark, d):
    docs = load(spark, d, "documents")
    lists = memo.hidden_groups(docs, docs.select("lang", "source").distinct(), text.contains_term(F.col("text"), "###"), "lang", "source")
    return lists.groupBy("lang").agg(F.bool_and("hidden").alias("hidden"), F.count_if("hidden").alias("hidden_lists"))


TWO_LEVELS = """WITH l AS (SELECT lang, source, NOT bool_or(contains(lower(text), '###')) AS hidden FROM documents GROUP BY lang, source)
SELECT lang, bool_and(hidden) AS hidden, count(*) FILTER (hidden) AS hidden_lists FROM l GROUP BY lang"""


def link_extract(spark, d):
    return load(spark, d, "pages").select("page_id", F.posexplode(text.links(F.col("html"))).alias("pos", "href")).withColumn("pos", F.col("pos").cast("long"))


LINKS = """SELECT page_id, unnest(range(len(l))) AS pos, unnest(l) AS href FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS l FROM pages)"""


def link_files(spark, d):
    name = F.regexp_replace(F.element_at(F.split("href", "/"), -1), r"\?.*$", "")
    return link_extract(spark, d).withColumn("name", name).filter(F.col("name").rlike(r"[a-m,.]$")).select("page_id", "pos", "name")


LINK_FILES = f"SELECT page_id, pos, regexp_replace(string_split(href, '/')[-1], '\\?.*$', '') AS name FROM ({LINKS}) WHERE regexp_matches(regexp_replace(string_split(href, '/')[-1], '\\?.*$', ''), '[a-m,.]$')"


def page_meta(spark, d):
    own = F.concat(F.lit("<meta content='It is \"page\" "), F.col("page_id").cast("string"), F.lit("' name=description x=1><meta content = \"About "), F.substring_index("url", "/", -1), F.lit("\" NAME='Description'><meta name='theme' data-n=\""), F.col("page_id").cast("string"), F.lit("\">"))
    h = F.concat(own, F.col("html"))
    return load(spark, d, "pages").select("page_id", text.html_attribute(h, "meta", "name", "theme", "data-n").alias("css"), F.coalesce(text.first_match(h, "<h1>(.*?)</h1>", "<title>(.*?)</title>"), F.lit("")).alias("heading"), text.html_attribute(h, "meta", "name", "description", "content").alias("description"))


PAGE_META = "SELECT page_id, page_id::VARCHAR AS css, coalesce(nullif(trim(regexp_extract(html, '(?is)<h1>(.*?)</h1>', 1)), ''), '') AS heading, trim('About ' || string_split(url, '/')[-1]) AS description FROM pages"


def toc_headings(spark, d):
    tags = F.regexp_extract_all("html", F.lit(r"(?is)<(h[1-6])>(.*?)</h[1-6]>"), F.lit(0))
    rows = load(spark, d, "pages").select("page_id", F.explode(tags).alias("tag"))
    return rows.select("page_id", F.regexp_extract("tag", r"(?is)^<h([1-6])>", 1).cast("long").alias("level"), F.regexp_replace("tag", r"(?is)</?h[1-6]>", "").alias("heading"))


TOC = r"""SELECT page_id, regexp_extract(tag, '(?is)^<h([1-6])>', 1)::BIGINT AS level, regexp_replace(tag, '(?is)</?h[1-6]>', '', 'g') AS heading
FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<(h[1-6])>(.*?)</h[1-6]>')) AS tag FROM pages)"""


def html_escape(spark, d):
    rows = load(spark, d, "pages").select("page_id", F.col("html").alias("h"))
    return rows.select("page_id", F.md5(text.escape(F.col("h"), slash=True)).alias("escaped"), F.md5(text.unescape(text.escape(F.col("h")))).alias("back"))


HTML_ESCAPE = f"SELECT page_id, md5(replace({_escaped('html')}, '/', '&#x2F;')) AS escaped, md5({_unescaped(_escaped('html'))}) AS back FROM pages"


def slugs(spark, d):
    rows = load(spark, d, "pages").select("page_id", "url", text.first_match(F.col("html"), "<title>(.*?)</title>").alias("title"))
    title = F.when(F.col("page_id") % 9 == 0, F.lit("### !!")).otherwise(F.col("title"))
    return rows.select("page_id", text.slugify(title, F.concat(F.lit("pages-"), F.col("page_id").cast("string"))).alias("slug"))


SLUGS = f"""WITH t AS (SELECT page_id, CASE WHEN page_id % 9 = 0 THEN '### !!' ELSE trim({_TITLE}) END AS title FROM pages),
s AS (SELECT page_id, regexp_replace(replace(lower(trim(title)), ' ', '-'), '[^0-9A-Za-z_-]', '', 'g') AS slug FROM t)
SELECT page_id, CASE WHEN regexp_matches(slug, '[0-9A-Za-z_]') THEN slug ELSE 'pages-' || page_id END AS slug FROM s"""


def transliterated(spark, d):
    return load(spark, d, "documents").select("doc_id", F.md5(text.transliterate(F.col("text"))).alias("digest"))


TRANSLIT = f"SELECT doc_id, md5(translate(text, '{_ACCENTS}', '{_BASES}')) AS digest FROM documents"


def cited_by(spark, d):
    desc = F.when(F.col("p_partkey") % 5 == 0, F.lit("no count")).when(F.col("p_partkey") % 5 < 4, F.concat(F.lit("x Cited by "), F.format_number(F.col("p_partkey") * 977, 0), F.lit(" y")))
    return load(spark, d, "part").select("p_partkey", text.cited_by(desc, F.lit("Cited by 12")).alias("cited"))


CITED_BY = r"""SELECT p_partkey, try_cast(replace(regexp_extract(coalesce(CASE WHEN p_partkey % 5 = 0 THEN 'no count' WHEN p_partkey % 5 < 4 THEN
'x Cited by ' || format('{:,}', p_partkey * 977) || ' y' END, 'Cited by 12'), 'Cited by ([0-9]+[,0-9]*)', 1), ',', '') AS BIGINT) AS cited FROM part"""


def humanize_count(spark, d):
    return load(spark, d, "part").select("p_partkey", text.humanize(F.col("p_partkey") * F.col("p_partkey") * 13).alias("human"))


HUMANIZE = """WITH t AS (SELECT p_partkey, p_partkey * p_partkey * 13 AS n FROM part),
u AS (SELECT *, CASE WHEN n >= 1e9 THEN 'B' WHEN n >= 1e6 THEN 'M' WHEN n >= 1e3 THEN 'K' ELSE '' END AS unit,
  n / CASE WHEN n >= 1e9 THEN 1e9::DOUBLE WHEN n >= 1e6 THEN 1e6::DOUBLE WHEN n >= 1e3 THEN 1e3::DOUBLE ELSE 1::DOUBLE END AS x FROM t)
SELECT p_partkey, CASE WHEN unit = '' THEN n::VARCHAR WHEN x >= 99.5 THEN (floor(x / 10 + 0.5) * 10)::BIGINT::VARCHAR || unit WHEN x >= 9.95 THEN floor(x + 0.5)::BIGINT::VARCHAR || unit
ELSE regexp_replace(printf('%.1f', floor(x * 10 + 0.5) / 10), '[.]0$', '') || unit END AS human FROM u"""


def author_string(spark, d):
    names = F.concat(F.lit("Doe, Jane and Sam "), F.col("c_mktsegment"), F.lit(" Roe"), F.when(F.col("c_custkey") % 2 == 0, " and Poe, Edgar A.").otherwise(""))
    return load(spark, d, "customer").select("c_custkey", text.author_string(names).alias("authors"))


AUTHORS = "SELECT c_custkey, 'Jane Doe' || CASE WHEN c_custkey % 2 = 0 THEN ', Sam ' || c_mktsegment || ' Roe and Edgar A. Poe' ELSE ' and Sam ' || c_mktsegment || ' Roe' END AS authors FROM customer"


def citation_names(spark, d):
    last = F.when(F.col("o_orderkey") % 4 > 0, F.slice(F.array(F.lit("Ng"), F.col("o_orderpriority"), F.lit("Wu")), F.lit(1), (F.col("o_orderkey") % 4).cast("int"))).otherwise(F.array().cast("array<string>"))
    rows = load(spark, d, "orders").withColumn("last", last)
    return rows.select("o_orderkey", text.short_authors(F.col("last")).alias("short"), text.citation_slug(F.get("last", F.lit(0)), F.year("o_orderdate"), F.concat(F.col("o_orderstatus"), F.lit(" x"))).alias("slug"), text.initials(F.concat(F.lit("Ann "), F.col("o_orderpriority"))).alias("initials"))


CITATION = """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 1 THEN 'Ng' WHEN 2 THEN 'Ng & ' || o_orderpriority WHEN 3 THEN 'Ng, et al.' END AS short,
CASE WHEN o_orderkey % 4 = 0 THEN 'Untitled' ELSE 'ng' || year(o_orderdate) || lower(o_orderstatus) END AS slug,
'A.' || list_aggregate(list_transform(list_filter(string_split(o_orderpriority, ' '), lambda w: w <> ''), lambda w: w[1] || '.'), 'string_agg', '') AS initials FROM orders"""


def strip_bibtex_fields(spark, d):
    """Records without two of their fields, and without the marks in author lines; each third line is only like one of them."""
    lines = F.concat(F.lit("@a{k,\n  title = {T & "), F.col("p_name"), F.lit("},\n  abbr = {"), F.col("p_brand"), F.lit("},\n  author = {"), F.col("p_type"), F.lit("*, B^† & C},\n  keynote = {&"), F.col("p_size").cast("string"), F.lit("},\n  note= {y}\n  xauthor = {Z*}\n}"))
    return load(spark, d, "part").select("p_partkey", text.strip_fields(lines, "abbr", "note").alias("bibtex"))


STRIP_BIB = """SELECT p_partkey, '@a{k,' || chr(10) || '  title = {T & ' || p_name || '},' || chr(10) || '  author = {' || p_type || ', B  C},' || chr(10) || '  keynote = {&' || p_size || '},' || chr(10) || '  xauthor = {Z*}' || chr(10) || '}' AS bibtex FROM part"""


def tex_normalized(spark, d):
    """Names whose vowels are written as accent commands of several forms, and words in braces that stay."""
    name = F.col("p_name")
    for letter, written in (("a", "{\\\\'a}"), ("e", '{\\\\" e}'), ("o", "{\\\\o}"), ("u", "{\\\\v u}"), (" ", " \n\t ")):
        name = F.regexp_replace(name, letter, written)
    return load(spark, d, "part").select("p_partkey", text.normalize_tex(F.concat(name, F.lit(" of {"), F.col("p_brand"), F.lit("}"))).alias("clean"))


def hash_terms(spark, d):
    return load(spark, d, "pages").select("page_id", text.url_hash_term(F.concat(F.col("url"), F.lit("%20A+b"))).alias("term"))


HASH_TERMS = "SELECT page_id, lower(url_decode(regexp_extract(url || '%20A+b', '#(.*)$', 1))) AS term FROM pages"


def data_keys(spark, d):
    name = F.concat(F.lit("mdbAuto"), F.initcap(F.lower("c_mktsegment")), F.lit("Show"))
    return load(spark, d, "customer").select("c_custkey", text.data_key(name).alias("attribute"), text.camel_key(name, "mdb").alias("property"))


DATA_KEYS = "SELECT c_custkey, 'mdb-auto-' || lower(c_mktsegment) || '-show' AS attribute, 'auto' || upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || 'Show' AS property FROM customer"


def coerced_scalars(spark, d):
    raw = F.element_at(F.array(F.lit("true"), F.lit("null"), F.lit(""), F.lit("1.50"), F.col("event_id").cast("string")), (F.col("event_id") % 5 + 1).cast("int"))
    return load(spark, d, "events").select("event_id", text.coerce_scalar(raw).alias("s")).select("event_id", "s.kind", "s.value")


COERCED = """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'boolean' WHEN 3 THEN 'string' WHEN 4 THEN 'number' ELSE 'null' END AS kind,
CASE event_id % 5 WHEN 0 THEN 'true' WHEN 3 THEN '1.50' WHEN 4 THEN event_id::VARCHAR END AS value FROM events"""


def asset_paths(spark, d):
    path = F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.concat(F.col("page_id").cast("string"), F.lit(".pdf")))
    return load(spark, d, "pages").select("page_id", text.asset_path(path).alias("path"), text.strip_paragraphs(F.concat(F.lit("<p class=x>"), F.col("url"), F.lit("</p>\n"))).alias("caption"))


ASSETS = "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE '/assets/pdf/' || page_id || '.pdf' END AS path, url AS caption FROM pages"


def md5_digest(spark, d):
    """Digests of ranges of 1000 ids first, then of these, so that no group gathers all files."""
    joined = lambda order, c: F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, c))), lambda x: x[c]), ""))
    files = load(spark, d, "pages").select("page_id", (F.col("page_id") % 10).alias("dir"), F.floor(F.col("page_id") / 1000).alias("range"), F.md5("html").alias("m"))
    return files.groupBy("dir", "range").agg(joined("page_id", "m").alias("m")).groupBy("dir").agg(joined("range", "m").alias("digest"))


MD5 = "SELECT dir, md5(string_agg(m, '' ORDER BY range)) AS digest FROM (SELECT page_id % 10 AS dir, page_id // 1000 AS range, md5(string_agg(md5(html), '' ORDER BY page_id)) AS m FROM pages GROUP BY ALL) GROUP BY 1"


def page_text_stats(spark, d):
    return load(spark, d, "pages").select("page_id", F.length(text.text_of(F.col("html"))).cast("long").alias("n_text"))


PAGE_TEXT = r"SELECT page_id, length(trim(regexp_replace(regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>|<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS n_text FROM pages"

QUERIES = {
    "feed_items": (feed_items, FEED_ITEMS),
    "feed_fallbacks": (feed_fallbacks, FEED_FALLBACKS),
    "feed_last_build": (feed_last_build, FEED_LAST_BUILD),
    "feed_stale_rows": (feed_stale_rows, FEED_STALE),
    "doc_search": (doc_search, "SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'tion the')"),
    "doc_search_node_scoped": (doc_search_node_scoped, NODE_SEARCH),
    "highlight_ranges": (highlight_ranges, HIGHLIGHT),
    "group_hidden": (group_hidden, GROUP_HIDDEN),
    "group_hidden_two_levels": (group_hidden_two_levels, TWO_LEVELS),
    "link_extract": (link_extract, LINKS),
    "link_files": (link_files, LINK_FILES),
    "page_meta": (page_meta, PAGE_META),
    "toc_headings": (toc_headings, TOC),
    "html_escape": (html_escape, HTML_ESCAPE),
    "slugify": (slugs, SLUGS),
    "transliterate": (transliterated, TRANSLIT),
    "cited_by": (cited_by, CITED_BY),
    "humanize_count": (humanize_count, HUMANIZE),
    "author_string": (author_string, AUTHORS),
    "citation_names": (citation_names, CITATION),
    "strip_bibtex_fields": (strip_bibtex_fields, STRIP_BIB),
    "tex_normalized": (tex_normalized, "SELECT p_partkey, p_name || ' of {' || p_brand || '}' AS clean FROM part"),
    "hash_terms": (hash_terms, HASH_TERMS),
    "data_keys": (data_keys, DATA_KEYS),
    "coerced_scalars": (coerced_scalars, COERCED),
    "asset_paths": (asset_paths, ASSETS),
    "md5_digest": (md5_digest, MD5),
    "page_text_stats": (page_text_stats, PAGE_TEXT),
}
