"""Keyed and positional data joins that split rows into update, enter and exit.

Keys compare as text; a missing key is the text null. Of rows with equal keys, the first on each
side joins; the others of the nodes exit and the others of the data enter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .positional import global_ordinal


#: Equal rows that are written out again from one array.
_COPIES = 10_000


def _text_key(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("null"))


def _split(df: DataFrame, group: str | None, key: str, order: str, value: str) -> tuple[DataFrame, DataFrame]:
    """(first rows of each key, the others), as (group, _key, _order, _value).

    The first is the least by order, null first, then value; it is found by partial aggregation, so
    a key that very many rows share, or lack, makes one row for each task before the shuffle. Equal
    rows are counted, and all but one of those that come first stay with the others.
    """
    on = ([group] if group else []) + ["_key"]
    rows = df.select(*([group] if group else []), _text_key(F.col(key)).alias("_key"), F.col(order).alias("_order"), F.col(value).alias("_value"))
    each = rows.groupBy(*on, "_order", "_value").agg(F.count("*").alias("_n"))
    first = each.groupBy(*on).agg(F.min(F.struct("_order", "_value")).alias("_f"))
    least = first.select(*(F.col(c).alias(f"_l{i}") for i, c in enumerate(on)), F.col("_f").alias("_lf"))
    same = F.lit(True)
    for i, c in enumerate(on):
        same &= F.col(c).eqNullSafe(F.col(f"_l{i}"))
    surplus = F.col("_n") - F.when(F.struct("_order", "_value").eqNullSafe(F.col("_lf")), 1).otherwise(0)
    rest = each.join(least, same).select(*on, "_order", "_value", surplus.alias("_n")).filter("_n > 0")
    rest = rest.withColumn("_part", F.explode(F.sequence(F.lit(0), F.call_function("div", F.col("_n") - 1, F.lit(_COPIES)))))
    copies = F.least(F.lit(_COPIES), F.col("_n") - F.col("_part") * _COPIES).cast("int")
    return first.select(*on, "_f.*"), rest.withColumn("_one", F.explode(F.array_repeat(F.lit(True), copies))).drop("_n", "_part", "_one")


def keyed(nodes: DataFrame, data: DataFrame, key: str, order: str, value: str, group: str | None = None) -> DataFrame:
    """(group, key, side, node_value, data_value, node_order, data_order), side update, enter or exit.

    Groups compare null-safely; every row of both inputs is in the result once, or in one pair.
    """
    on = ([group] if group else []) + ["_key"]
    named = lambda df, name: df.withColumnsRenamed({"_order": f"{name}_order", "_value": f"{name}_value"})
    (n, more_n), (d, more_d) = (tuple(named(x, name) for x in _split(df, group, key, order, value)) for df, name in ((nodes, "node"), (data, "data")))
    n = n.withColumn("_in_nodes", F.lit(True))
    d = d.withColumnsRenamed({c: f"_d_{c}" for c in on}).withColumn("_in_data", F.lit(True))
    same = F.lit(True)
    for c in on:
        same &= F.col(c).eqNullSafe(F.col(f"_d_{c}"))
    side = F.when(F.col("_in_nodes") & F.col("_in_data"), "update").when(F.col("_in_data"), "enter").otherwise("exit")
    both = n.join(d, same, "full_outer").withColumn("side", side)
    for c in on:
        both = both.withColumn(c, F.when(F.col("_in_nodes"), F.col(c)).otherwise(F.col(f"_d_{c}")))
    out = both.drop("_in_nodes", "_in_data", *(f"_d_{c}" for c in on))
    for r in (more_n.withColumn("side", F.lit("exit")), more_d.withColumn("side", F.lit("enter"))):
        out = out.unionByName(r, allowMissingColumns=True)
    return out.withColumnRenamed("_key", "key")


def joined(result: DataFrame) -> DataFrame:
    """What stays after a join: enter and update rows, with the data's value."""
    return result.filter("side <> 'exit'")


def bind_order(result: DataFrame, group: str, order: str = "data_order") -> DataFrame:
    """The rows with their place, from 0, in the order of the data within each group."""
    return result.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1)


def _places(df: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """(group, pos, value): rows numbered from 0 within their group, without a task for each group.

    All rows are numbered by group and order in ranges; a group's first number is taken off.
    """
    rows = global_ordinal(df.select(group, order, value), group, F.col(order), name="_at")
    first = rows.groupBy(F.col(group).alias("_g")).agg(F.min("_at").alias("_first"))
    return rows.join(first, F.col(group).eqNullSafe(F.col("_g"))).select(group, (F.col("_at") - F.col("_first")).alias("pos"), value)


def positional(nodes: DataFrame, data: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Joins row by row in order within each group; a null group is one."""
    n = _places(nodes, group, order, value).select(F.col(group).alias("_ng"), F.col("pos").alias("_np"), F.col(value).alias("node_value"), F.lit(True).alias("_n"))
    d = _places(data, group, order, value).select(F.col(group).alias("_dg"), F.col("pos").alias("_dp"), F.col(value).alias("data_value"), F.lit(True).alias("_d"))
    side = F.when(F.col("_n") & F.col("_d"), "update").when(F.col("_d"), "enter").otherwise("exit")
    either = lambda a, b: F.when(F.col("_n"), F.col(a)).otherwise(F.col(b))
    both = n.join(d, F.col("_ng").eqNullSafe(F.col("_dg")) & (F.col("_np") == F.col("_dp")), "full_outer")
    return both.select(either("_ng", "_dg").alias(group), either("_np", "_dp").alias("pos"), "node_value", "data_value", side.alias("side"))


def zipped(nodes: DataFrame, data: DataFrame, order: list[str], value: str) -> DataFrame:
    """(pos, node_value, data_value, side): row by row in the order of both whole tables, which are numbered in ranges."""
    n, d = (global_ordinal(df.select(*order, value), order[0], *map(F.col, order[1:]), name="pos").select("pos", F.col(value).alias(f"{side}_value"), F.lit(True).alias(f"_{side}")) for df, side in ((nodes, "node"), (data, "data")))
    side = F.when(F.col("_node") & F.col("_data"), "update").when(F.col("_data"), "enter").otherwise("exit")
    return n.join(d, "pos", "full_outer").select("pos", "node_value", "data_value", side.alias("side"))


def merge(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Slot by slot the first value, else the second."""
    right = b.select(*keys, F.col(value).alias("_other"))
    return a.join(right, keys, "full_outer").select(*keys, F.coalesce(value, "_other").alias(value))
