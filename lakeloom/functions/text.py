"""Column expressions over text: extraction, escaping, names, slugs, counts, highlights."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import let


def falsy_to_null(c: Column) -> Column:
    """Empty text counts as missing."""
    return F.nullif(c, F.lit(""))


#: The blanks of Unicode (category Zs).
_BLANKS = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def first_match(text: Column, *patterns: str) -> Column:
    """Group 1 of the first pattern that gives a non-empty match, without the blanks around it; null without one."""
    return F.coalesce(*(falsy_to_null(F.btrim(F.regexp_extract(text, f"(?is){p}", 1), F.lit(_BLANKS))) for p in patterns))


def tag_attributes(html: Column, tag: str) -> Column:
    """Of each such tag in order, a map of its quoted attributes by lower-case name; of repeated names the first."""
    tags = F.regexp_extract_all(html, F.lit(rf"""(?i)<{tag}(?=[\s/>])(?:"[^"]*"|'[^']*'|[^"'>])*>"""), F.lit(0))
    pair = r"""([\w:.-]+)\s*=\s*("[^"]*"|'[^']*')"""

    def attributes(one: Column) -> Column:
        found = F.transform(F.regexp_extract_all(one, F.lit(pair), F.lit(0)), lambda p: F.struct(F.lower(F.regexp_extract(p, pair, 1)).alias("k"), F.trim(F.regexp_replace(F.regexp_extract(p, pair, 2), "^.|.$", "")).alias("v")))
        return F.map_from_entries(F.filter(found, lambda p, i: ~F.exists(F.slice(found, F.lit(1), i), lambda q: q["k"] == p["k"])))

    return F.transform(tags, attributes)


def html_attribute(html: Column, tag: str, key: str, value: str, attribute: str) -> Column:
    """An attribute of the first tag whose key attribute has the value, in any order; null if missing or empty."""
    fits = F.filter(tag_attributes(html, tag), lambda m: (F.lower(F.element_at(m, key)) == value.lower()) & F.map_contains_key(m, attribute))
    return falsy_to_null(F.element_at(F.get(fits, F.lit(0)), attribute))


#: The entities that are written and read.
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&amp;", "&"))


def unescape(c: Column) -> Column:
    """The five basic entities; the ampersand last."""
    return reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), _ENTITIES, c)


def escape(c: Column, slash: bool = False) -> Column:
    """The reverse; the ampersand first. slash: also the solidus."""
    out = reduce(lambda x, e: F.replace(x, F.lit(e[1]), F.lit(e[0])), reversed(_ENTITIES), c)
    return F.replace(out, F.lit("/"), F.lit("&#x2F;")) if slash else out


def slugify(title: Column, fallback: Column) -> Column:
    """Lower-case words joined by hyphens; the fallback where no word character is left."""
    slug = F.regexp_replace(F.replace(F.lower(F.trim(title)), F.lit(" "), F.lit("-")), r"[^\w-]", "")
    return F.when(slug.rlike(r"\w"), slug).otherwise(fallback)


def accent_map() -> tuple[str, str]:
    """Accented Latin letters and their bases, from canonical decomposition."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x180)]
    pairs = [(a, b) for a, b in pairs if b.isascii() and b.isalpha()] + [("ø", "o"), ("Ø", "O")]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def transliterate(c: Column) -> Column:
    return F.translate(c, *accent_map())


#: The signs that mark authors.
_MARKS = "*†‡§¶‖&^"


def strip_fields(bibtex: Column, *keywords: str) -> Column:
    """Removes the lines that set one of the fields in braces, and the marks of authors from the lines that set them.

    A name counts wherever it stands as a word before ` = {`; a last line without an end stays as it is.
    """
    names = "|".join(map(re.escape, keywords))
    kept = F.regexp_replace(bibtex, rf"(?dm)^.*\b(?:{names})\b *= *\{{.*\n", "") if keywords else bibtex
    lines = F.split(kept, "\n", -1)
    is_author = lambda line, i: line.rlike(r"\bauthor\b *= *\{") & (i < F.size(lines) - 1)
    return F.array_join(F.transform(lines, lambda line, i: F.when(is_author(line, i), F.translate(line, _MARKS, "")).otherwise(line)), "\n")


def busted(url: Column, content: Column) -> Column:
    """A URL that changes with its content."""
    return F.concat(url, F.lit("?"), F.md5(content))


def cited_by(description: Column, fallback: Column) -> Column:
    """The count after "Cited by"; only a null description falls back; all commas go."""
    text = F.coalesce(description, fallback)
    after = F.when(F.contains(text, F.lit("Cited by ")), F.get(F.split(text, "Cited by "), F.lit(1)))
    number = F.replace(F.get(F.split(after, "[^0-9,]"), F.lit(0)), F.lit(","), F.lit(""))
    return number.try_cast("bigint")


def humanize(n: Column) -> Column:
    """Counts at two significant digits with K, M or B; zeros that say nothing go."""
    out = n.cast("string")
    for size, unit in ((1e3, "K"), (1e6, "M"), (1e9, "B")):
        x = n / F.lit(size)
        digits = F.when(x >= 99.5, F.floor(x / 10 + 0.5) * 10).when(x >= 9.95, F.floor(x + 0.5)).otherwise(F.floor(x * 10 + 0.5) / 10)
        shown = F.regexp_replace(F.format_string("%.1f", digits.cast("double")), r"\.0$", "")
        out = F.when(n >= size, F.concat(shown, F.lit(unit))).otherwise(out)
    return out


def author_parts(name: Column) -> Column:
    """(first, last) of "Last, First" or "First Middle Last"."""
    comma = F.split(name, ", *")
    space = F.split(F.trim(name), " +")
    return F.when(name.contains(","), F.struct(F.get(comma, F.lit(1)).alias("first"), F.get(comma, F.lit(0)).alias("last"))).otherwise(F.struct(F.array_join(F.slice(space, 1, F.greatest(F.size(space) - 1, F.lit(0))), " ").alias("first"), F.element_at(space, -1).alias("last")))


def author_string(names: Column, separator: str = ", ", final: str = " and ") -> Column:
    """ "First Last" of names that " and " parts, joined with a last separator of its own."""
    people = F.transform(F.split(names, " and "), author_parts)
    shown = F.transform(people, lambda p: F.trim(F.concat_ws(" ", p["first"], p["last"])))
    n = F.size(shown)
    return F.when(n > 1, F.concat(F.array_join(F.slice(shown, F.lit(1), n - 1), separator), F.lit(final), F.element_at(shown, -1))).otherwise(F.get(shown, F.lit(0)))


def full_names(names: Column) -> Column:
    """ "Last, First" of each name, joined by " and "; a name of one word stands alone."""
    return F.array_join(F.transform(names, lambda n: let(author_parts(n), lambda p: F.concat_ws(", ", p["last"], F.nullif(F.trim(p["first"]), F.lit(""))))), " and ")


def initials(first: Column) -> Column:
    """ "Ann Beth" as "A.B."."""
    return F.array_join(F.transform(F.filter(F.split(first, " +"), lambda w: w != ""), lambda w: F.concat(F.substring(w, 1, 1), F.lit("."))), "")


def short_authors(last_names: Column) -> Column:
    """A / A & B / A, et al."""
    n = F.size(last_names)
    first, second = F.get(last_names, F.lit(0)), F.get(last_names, F.lit(1))
    return F.when(n > 2, F.concat(first, F.lit(", et al."))).when(n == 2, F.concat(first, F.lit(" & "), second)).otherwise(first)


def citation_slug(last_name: Column, year: Column, title: Column) -> Column:
    """Last name, year and first title word, in lower case; Untitled without an author."""
    slug = F.concat(F.lower(last_name), year.cast("string"), F.lower(F.get(F.split(title, " "), F.lit(0))))
    return F.when(last_name.isNull(), F.lit("Untitled")).otherwise(slug)


#: Accent commands, and letters that stand for themselves.
_ACCENT = r"\{\\[\"^`.'acu~Hvs] ?([a-zA-Z])\}"
_LETTER = r"\{\\([a-zA-Z])\}"


def normalize_tex(c: Column) -> Column:
    """White space to single spaces, and accented and special letters in braces to the letter; other braces stay."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"[\t\n ]+", " "), _ACCENT, "$1"), _LETTER, "$1")


def occurrences(rows: DataFrame, key: str, text: Column, term: Column) -> DataFrame:
    """(key, start, stop) of non-overlapping occurrences, left to right, from 0; none for an empty term.

    The text is split at the term and the lengths of the pieces are summed up along each row, so
    the time grows with the text alone.
    """
    held = rows.select(key, F.monotonically_increasing_id().alias("_row"), text.alias("_text"), term.alias("_term")).filter("_term <> ''")
    pieces = F.split("_text", F.concat(F.lit(r"\Q"), F.col("_term"), F.lit(r"\E")), -1)
    each = held.select(key, "_row", F.length("_term").alias("_n"), F.posexplode(pieces).alias("_at", "_piece"))
    before = F.sum(F.length("_piece")).over(Window.partitionBy(key, "_row").orderBy("_at")) + F.col("_at") * F.col("_n")
    last = F.max("_at").over(Window.partitionBy(key, "_row"))
    hits = each.withColumns({"start": before, "_last": last}).filter("_at < _last")
    return hits.select(key, "start", (F.col("start") + F.col("_n")).alias("stop"))


def contains_term(text: Column, term: str) -> Column:
    """Case-insensitive substring test; an empty term matches all."""
    return F.contains(F.lower(text), F.lit(term.lower())) if term else F.lit(True)


def node_contains_term(html: Column, term: str) -> Column:
    """As contains_term, with the match inside one text node."""
    if not term:
        return F.lit(True)
    return F.exists(F.split(html, "<[^>]*>"), lambda s: F.contains(F.lower(s), F.lit(term.lower())))


def name_place(c: Column, names: tuple[str, ...]) -> Column:
    """The place, from 0, of the first listed name that the text begins with, whatever its case; null if none."""
    low = F.lower(c)
    return F.coalesce(*(F.when(F.startswith(low, F.lit(name.lower())), i) for i, name in enumerate(names)))


def url_hash_term(url: Column) -> Column:
    """The decoded fragment of a URL, in lower case; plus signs stay."""
    return F.lower(F.url_decode(F.replace(F.regexp_extract(url, "#(.*)$", 1), F.lit("+"), F.lit("%2B"))))


def data_key(name: Column) -> Column:
    """camelCase to hyphens."""
    return F.lower(F.regexp_replace(name, "([A-Z])", "-$1"))


def camel_key(name: Column, prefix: str) -> Column:
    """Strips the prefix and lowers the first letter."""
    rest = F.regexp_replace(name, f"^{prefix}", "")
    return F.concat(F.lower(F.substring(rest, 1, 1)), F.substring(rest, 2, 1_000_000))


def coerce_scalar(raw: Column) -> Column:
    """(kind, value) of attribute text: boolean, number (canonical integers), null or string."""
    kind = F.when(raw.isin("true", "false"), "boolean").when(raw.rlike("^(0|-?[1-9][0-9]{0,14})$"), "number").when(raw.isNull() | raw.isin("", "null"), "null").otherwise("string")
    return F.struct(kind.alias("kind"), F.when(kind != "null", raw).alias("value"))


def asset_path(path: Column, base: str = "/assets/pdf/") -> Column:
    """Absolute URLs as they are, others below the base."""
    return F.when(path.contains("://"), path).otherwise(F.concat(F.lit(base), path))


def strip_paragraphs(c: Column) -> Column:
    """Without p tags and a line feed at the end."""
    bare = F.array_join(F.transform(F.split(c, "(?i)<(?=/?p[\\s>])"), lambda part, i: F.when(i == 0, part).otherwise(F.substr(part, F.instr(part, ">") + 1))), "")
    return F.rtrim(bare, F.lit("\n"))


def links(html: Column) -> Column:
    """Targets of href attributes, in order."""
    return F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1))


def text_of(html: Column) -> Column:
    """Markup off, white space to single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, r"(?s)<script.*?</script>|<style.*?</style>|<[^>]*>", " "), r"\s+", " "))
