"""Column expressions over citation and configuration records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def setting(value: Column, allowed: tuple[str, ...], default: str) -> Column:
    """The value if it is one of those allowed, else the default."""
    return F.when(value.isin(*allowed), value).otherwise(F.lit(default))


def venue_line(volume: Column, issue: Column, pages: Column, publisher: Column) -> Column:
    """ "volume(issue), pages. publisher" with missing parts left out."""
    head = F.concat(F.coalesce(volume, F.lit("")), F.when(issue.isNotNull(), F.concat(F.lit("("), issue, F.lit(")"))).otherwise(""))
    return F.concat_ws(". ", F.concat_ws(", ", F.nullif(head, F.lit("")), pages), publisher)


def paper_link(url: Column) -> Column:
    """(label, href): abstract pages of preprints lead to their PDF."""
    href = F.when(url.contains("arxiv.org/abs/"), F.concat(F.replace(url, F.lit("/abs/"), F.lit("/pdf/")), F.lit(".pdf"))).otherwise(url)
    label = F.when(href.endswith(".pdf"), "PDF").when(href.endswith(".html"), "HTML").otherwise("link")
    return F.struct(label.alias("label"), href.alias("href"))


def doi_link(doi: Column) -> Column:
    """A resolver URL of a DOI that may come with or without one."""
    bare = F.regexp_replace(doi, r"^(https?://)?(dx\.)?doi\.org/", "")
    return F.when(doi.isNotNull() & (bare != ""), F.concat(F.lit("https://doi.org/"), bare))


def periodical(kind: Column, journal: Column, booktitle: Column, month: Column, year: Column) -> Column:
    """Where a record appeared, by its type, with month and year."""
    place = F.when(kind == "article", F.concat(F.lit("In "), journal)).when(kind.isin("inproceedings", "incollection"), F.concat(F.lit("In "), booktitle)).when(kind.isin("thesis", "phdthesis"), F.lit("Thesis"))
    return F.concat_ws(", ", place, F.concat_ws(" ", month, year.cast("string")))


def bibtex(kind: Column, key: Column, tags: Column) -> Column:
    """A record as BibTeX text; tags in the order of their names."""
    lines = F.transform(F.array_sort(F.map_entries(tags)), lambda t: F.concat(F.lit("  "), t["key"], F.lit(" = {"), t["value"], F.lit("}")))
    return F.concat(F.lit("@"), kind, F.lit("{"), key, F.lit(",\n"), F.array_join(lines, ",\n"), F.lit("\n}"))


def substituted(urls: Column, version: Column) -> Column:
    """A map of URL templates with {{version}} filled in."""
    return F.transform_values(urls, lambda _, v: F.replace(v, F.lit("{{version}}"), version))


def url_of(raw_json: Column, field: str) -> Column:
    """A field that is a string, or an object whose values are strings: as an array of strings."""
    scalar = F.get_json_object(raw_json, f"$.{field}")
    nested = F.from_json(scalar, "map<string,string>", {"mode": "PERMISSIVE"})
    return F.when(scalar.startswith("{"), F.map_values(nested)).when(scalar.isNotNull(), F.array(scalar))


def affiliations(many: Column, one: Column, url: Column) -> Column:
    """The list of affiliations; the old single form becomes a list of one; an empty list stays."""
    single = F.array(F.struct(one.alias("name"), url.alias("url")))
    return F.when(many.isNull() & one.isNotNull(), single).otherwise(many)


def published(text: Column, typed: Column) -> Column:
    """A date given as a typed value, or as text; null where neither can be read."""
    return F.coalesce(typed.cast("timestamp"), F.try_to_timestamp(text))


def without_at(values: Column, position: Column) -> Column:
    """The array less the element at a 0-based position."""
    return F.filter(values, lambda _, i: i != position)


def type_checks(rules: dict[str, str]) -> Column:
    """Of each named column (name, kind, ok): its type's name, null for a missing value, and whether that matches the rule's pattern."""
    kind = lambda n: F.when(F.col(n).isNull(), F.lit("null")).otherwise(F.typeof(F.col(n)))
    return F.array(*(F.struct(F.lit(n).alias("name"), kind(n).alias("kind"), kind(n).rlike(p).alias("ok")) for n, p in rules.items()))


def required(name: str, rules: dict[str, str]) -> Column:
    """True where each named column's type matches its rule, a pattern over type names; the query fails with what is wrong where one does not."""
    ok = F.lit(True)
    for column, pattern in rules.items():
        kind = F.when(F.col(column).isNull(), F.lit("null")).otherwise(F.typeof(F.col(column)))
        wrong = F.raise_error(F.concat(F.lit(f"{name}: option {column} is "), kind, F.lit(f", expected {pattern}"))).cast("boolean")
        ok = F.when(kind.rlike(f"^(?:{pattern})$"), ok).otherwise(wrong)
    return ok
