"""Logs of commands replayed as tables: a store that holds one key for each owner."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(log: DataFrame, owner: str, order: list[str], command: Column, key: str) -> DataFrame:
    """The log with `island`: a number that grows within an owner wherever the store is empty for sure.

    A key can only be held if it has been set after its last removal. Sets and removals that change
    this count up and down; where no key is left, whatever came before does not matter any more.
    """
    same = Window.partitionBy(owner, key).orderBy(*order)
    along = Window.partitionBy(owner).orderBy(*order)
    moves = F.when(command == "set", 1).when(command == "remove", 0)
    before = F.coalesce(F.last(moves, ignorenulls=True).over(same.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = log.withColumn("_step", F.coalesce(moves - before, F.lit(0)))
    rows = rows.withColumn("_free", F.sum("_step").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_step") == 0)
    return rows.withColumn("island", F.sum(F.col("_free").cast("int")).over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("long")).drop("_step", "_free")


def replay(log: DataFrame, owner: str, order: list[str], command: str, key: str, value: str) -> DataFrame:
    """(owner, order, command, key, accepted, result): what each command met in a store of one key for each owner.

    A set is refused while another key is held, else it takes effect, and overwrites the value of its
    own key. A remove takes effect if its key is held, and then empties the store. A get answers with
    the value of its key, or null. accepted says whether a set or remove took effect or a get found
    its key; result is the value of the command's key after it, null if it is not held.

    Commands are read in order with the state carried along, from one batch to the next, so an owner
    may have any number of them; owners with many are dealt out by islands, between which no state
    passes. Keys compare as they are, a null key is a key; an unknown command is not accepted.
    """
    rows = islands(log, owner, order, F.col(command), key)
    cols = [owner, *order, command, key]
    kinds = dict(log.dtypes)
    held = rows.repartition(owner, "island").sortWithinPartitions(owner, "island", *order).select("island", *cols, value)

    def run(batches):
        place, kept, has, content = None, None, False, None
        for batch in batches:
            at = {n: batch.column(i).to_pylist() for n, i in (("island", 0), ("owner", 1), ("command", len(cols) - 1), ("key", len(cols)), ("value", len(cols) + 1))}
            accepted, result = [], []
            for island, who, act, k, v in zip(at["island"], at["owner"], at["command"], at["key"], at["value"], strict=True):
                if (who, island) != place:
                    place, has, content = (who, island), False, None
                own = has and kept == k
                done = (own or not has) if act == "set" else own and act in ("get", "remove")
                if done and act == "set":
                    kept, has, content = k, True, v
                elif done and act == "remove":
                    has, content = False, None
                accepted.append(done)
                result.append(content if has and kept == k else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:-1], pa.array(accepted), pa.array(result, batch.schema.field(len(cols) + 1).type)], names=[*cols, "accepted", "result"])

    return held.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in cols), "accepted boolean", f"result {kinds[value]}"]))
