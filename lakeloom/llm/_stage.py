"""Intermediate tables in the folder the cluster shares, so that lost executors cost no lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: list[str] = []
_OPEN: dict[str, SparkSession] = {}
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Lets joins and groups use the buckets of kept tables, and the order inside these.
_BUCKETS = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.legacy.bucketedTableScan.outputOrdering": "true"}
MOST_BUCKETS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, a temporary one in local mode and an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    master = spark.sparkContext.master
    if master.split("[")[0] != "local":
        raise ValueError(f"spark.checkpoint.dir must name a folder that all executors share (master {master})")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="lakeloom-"))
    return _OWN[0]


@contextmanager
def configured(spark: SparkSession, values: dict[str, str]):
    """Settings of the session while the block runs."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def clear() -> None:
    """Removes the kept tables of all runs; results that still read from them are gone too. Runs at exit as well."""
    while _OPEN:
        name, spark = _OPEN.popitem()
        if spark.sparkContext._jsc is not None:  # else the session has been stopped
            spark.sql(f"DROP DATABASE IF EXISTS {name} CASCADE")


atexit.register(clear)


class Stage:
    """Tables of one run of an operator, in a database of its own below the shared folder.

    `keep` writes a table and reads it back, without the shuffle files of its making; `drop`
    removes tables that nothing reads any more. With `by`, the table is kept in buckets of that
    column, sorted by `order`, so that later joins and groups on it need no exchange.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.name = f"lakeloom_{label.replace('-', '_')}_{uuid.uuid4().hex}"
        self.at = 0
        self.tables: dict[int, tuple[str, DataFrame]] = {}
        spark.sql(f"CREATE DATABASE {self.name} LOCATION '{shared_dir(spark)}/{self.name}'")
        _OPEN[self.name] = spark
        self.buckets = max(1, min(MOST_BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def keep(self, df: DataFrame, by: str | None = None, order: tuple[str, ...] = (), dealt: bool = False) -> DataFrame:
        """dealt: the rows come from tables in the same buckets already."""
        self.at += 1
        table = f"{self.name}.t{self.at}"
        if by and not dealt:
            df = df.repartition(self.buckets, F.col(by))
        writer = df.write.format("parquet").option("compression", "zstd")
        if by:
            writer = writer.bucketBy(self.buckets, by).sortBy(by, *order)
        with configured(self.spark, {_CLEAN: "true"} | _BUCKETS):
            writer.saveAsTable(table)
        out = self.spark.table(table)
        self.tables[id(out)] = (table, out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            if held := self.tables.pop(id(df), None):
                self.spark.sql(f"DROP TABLE {held[0]}")
