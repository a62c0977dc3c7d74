"""The star-schema and corpus tables of a folder, and in-memory tables of literal rows."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NAMES = tuple("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split())


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of the folder; columns and filters are pushed into the scan by use."""
    if name not in NAMES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt evenly over as many tasks as a shuffle has, for work that is large against a row's bytes.

    A scan makes tasks by bytes of files, so a small file is one task however much work its rows are.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def share_code(spark: SparkSession) -> None:
    """Lets Python workers import this library where it was not installed but put on the driver's path."""
    root = str(Path(__file__).resolve().parents[2])
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Multi-line JSON documents, each a record or a list of them, with a stated schema (no inference pass); one that cannot be read fails the query."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def text_files(spark: SparkSession, glob: str) -> DataFrame:
    """Whole text files as (path, text, modified); bytes that are not UTF-8 are replaced."""
    files = spark.read.format("binaryFile").load(glob)
    return files.selectExpr("path", "make_valid_utf8(cast(content as string)) as text", "modificationTime as modified")


def post_files(spark: SparkSession, root: str) -> DataFrame:
    """Files <year>/<slug>/index.html below root: four-digit years, real slugs."""
    files = text_files(spark, f"{root}/*/*/index.html")
    parts = files.selectExpr("*", "split(path, '/') as parts").selectExpr("path", "text", "modified", "element_at(parts, -3) as year", "element_at(parts, -2) as slug")
    return parts.filter("year rlike '^[0-9]{4}$' and slug <> '' and slug <> 'index.html'")


def rss_items(spark: SparkSession, path: str, schema: str | None = None, trim: bool = True) -> DataFrame:
    """Items of RSS files, one row each; a stated schema saves the pass that infers one.

    A feed may be spread over many files, as `feed.render` writes it, so that a file alone is no
    document: texts are cut behind the end tag of each item, wherever it stands, and each item is
    read by itself. One that cannot be read gives nulls and costs no other. White space around a
    value is layout; without trim it belongs to the value.
    """
    ended = spark.read.option("lineSep", "</item>").text(path)
    start = F.regexp_extract("value", r"(?s)<item(?:\s[^>]*)?>.*", 0)
    items = ended.select(start.alias("item")).filter("item <> ''").select(F.concat("item", F.lit("</item>")).alias("item"))
    spaces = {"ignoreSurroundingSpaces": str(trim).lower()}
    if schema is None:
        schema = spark.read.options(**spaces).option("rowTag", "item").xml(items.rdd.map(lambda r: r.item)).schema
    return items.select(F.from_xml("item", schema, spaces).alias("i")).select("i.*")


def yaml_records(rows: DataFrame, key: str, body: str) -> DataFrame:
    """(key, name, item, field, value) of YAML texts: named records, or named lists of records.

    Read are top-level names, `field: value` lines below them (item 0), and lists whose records
    begin with a dash (items from 1), whose name is null if none stands before. Values are texts
    without their quotes; bracketed lists stay as they stand; comments, empty lines and fields
    outside a record are left out. Deeper nesting is not told apart from its record. A null text
    gives no rows.
    """
    comment = r"""^((?:"[^"]*"|'[^']*'|[^"'#]|(?<=\S)#)*?)\s+#.*$"""
    lines = rows.select(key, F.posexplode(F.split(body, "\r?\n")).alias("_at", "_raw")).filter("not trim(_raw) like '#%' and trim(_raw) <> ''")
    line = F.rtrim(F.regexp_replace("_raw", comment, "$1"))
    bare = lambda c: F.when(c.rlike("""^("[^"]*"|'[^']*')$"""), F.substr(c, F.lit(2), F.length(c) - 2)).otherwise(c)
    held = lines.withColumn("_line", line).withColumns({
        "_top": F.when(F.col("_line").rlike(r"^[^\s-].*:$"), F.regexp_replace("_line", ":$", "")),
        "_dash": F.col("_line").rlike(r"^\s*- ").cast("int"),
        "_pair": F.trim(F.regexp_replace("_line", r"^\s*- ", "")),
    })
    before = Window.partitionBy(key).orderBy("_at")
    held = held.withColumn("_name", F.last("_top", ignorenulls=True).over(before))
    named = Window.partitionBy(key, "_name").orderBy("_at")
    held = held.withColumn("item", F.sum("_dash").over(named).cast("long")).filter(r"_top is null and (_name is not null or item > 0) and _line rlike '^(\\s|- )' and instr(_pair, ': ') > 0")
    value = F.trim(F.substr("_pair", F.instr("_pair", ": ") + 2))
    return held.select(key, bare(F.col("_name")).alias("name"), "item", bare(F.substring_index("_pair", ": ", 1)).alias("field"), bare(value).alias("value"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder path that driver and executors share, below spark.checkpoint.dir; a temporary one in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp()
    return f"{root}/{name}-{uuid.uuid4().hex}"


_SCRATCH: list[tuple[SparkSession, str]] = []


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A shared folder for what a result reads until the program ends; `clear_scratch` removes it."""
    path = shared_folder(spark, name)
    _SCRATCH.append((spark, path))
    return path


def clear_scratch() -> None:
    """Removes all scratch folders; results that still read from them are gone too. Runs at exit as well."""
    while _SCRATCH:
        spark, path = _SCRATCH.pop()
        if spark.sparkContext._jsc is not None:  # else the session has been stopped
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


atexit.register(clear_scratch)


def write_once(df: DataFrame, path: str) -> None:
    """Writes unless the target is there already."""
    df.write.mode("ignore").parquet(path)
