"""Nested documents as table cells, configuration merging, and search with group roll-up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cells(documents: DataFrame, key: str, items: str, classes: str) -> DataFrame:
    """(key, row, col, value, css, link): item values by position; a link on the last value only.

    items is an array of structs (values, url); a value without a class has an empty one.
    """
    rows = documents.select(key, classes, F.posexplode(items).alias("row", "item"))
    each = rows.select(key, "row", classes, F.col("item.url").alias("url"), F.size("item.values").alias("n"), F.posexplode("item.values").alias("col", "value"))
    css = F.coalesce(F.get(classes, F.col("col")), F.lit(""))
    link = F.when((F.col("col") == F.col("n") - 1) & (F.col("url") != ""), F.col("url"))
    return each.select(key, "row", "col", "value", css.alias("css"), link.alias("link"))


def standard_cells(documents: DataFrame, key: str, items: str) -> DataFrame:
    """(key, row, date, title, url) of items; missing fields stay null."""
    return documents.select(key, F.posexplode(items).alias("row", "item")).select(key, "row", "item.date", "item.title", "item.url")


def overlay(*maps: Column) -> Column:
    """Maps merged; later ones win."""

    def onto(under: Column, over: Column) -> Column:
        return F.map_concat(F.map_filter(under, lambda k, v: ~F.map_contains_key(over, k)), over)

    return reduce(onto, maps)


def hidden_groups(rows: DataFrame, groups: DataFrame, visible: Column, *by: str) -> DataFrame:
    """Groups without a visible member; a group without members is hidden."""
    shown = rows.groupBy(*by).agg(F.bool_or(visible).alias("shown"))
    return groups.join(shown, list(by), "left").select(*by, (~F.coalesce("shown", F.lit(False))).alias("hidden"))
