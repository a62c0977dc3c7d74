"""Sources and sinks on small files."""

import json
import os

import pytest
from pyspark.sql import functions as F

from lakeloom.operators import feed
from lakeloom.sources import tables


def test_post_files_by_path_shape(spark, tmp_path):
    for path, body in {"2024/one/index.html": b"<title>\xff One</title>", "page/2/index.html": b"<title>no</title>", "2025/index.html": b"no", "2025/two/index.html": b"<title>Two</title>"}.items():
        f = tmp_path / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(body)
    got = {(r.year, r.slug): r.text for r in tables.post_files(spark, str(tmp_path)).collect()}
    assert sorted(got) == [("2024", "one"), ("2025", "two")]
    posts = feed.posts(tables.post_files(spark, str(tmp_path)), "slug", "text", F.concat(F.lit("https://x/"), F.col("year"), F.lit("/"), F.col("slug"), F.lit("/")), F.col("modified"))
    assert sorted(r.title[-3:] for r in posts.collect()) == ["One", "Two"]


def test_json_rss_and_single_write(spark, tmp_path):
    (tmp_path / "memo.json").write_text(json.dumps({"title": "T", "items": [{"date": "1", "title": "a"}, {"date": None, "title": "b"}]}, indent=1))
    memo = tables.json_documents(spark, str(tmp_path / "memo.json"), "title string, items array<struct<date string, title string, url string>>")
    assert memo.select(F.explode("items").alias("i")).select("i.title").count() == 2
    (tmp_path / "feed.xml").write_text("<rss><channel><item><title>x</title></item><item><title>y</title></item></channel></rss>")
    assert sorted(r.title for r in tables.rss_items(spark, str(tmp_path / "feed.xml")).collect()) == ["x", "y"]
    out = str(tmp_path / "once")
    tables.write_once(spark.range(3).toDF("a"), out)
    tables.write_once(spark.range(9).toDF("a"), out)
    assert spark.read.parquet(out).count() == 3


def test_rendered_feed_is_whole_and_in_order(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"<title>t{i}</title>", f"u{i:02d}") for i in range(30)], "id long, html string, url string")
    found = feed.posts(pages, "id", "html", F.col("url"), F.timestamp_add("DAY", (F.col("id") % 7).cast("int"), F.lit("2025-01-01").cast("timestamp")))
    feed.render(feed.items(found), "All", str(tmp_path / "rss"))
    lines = "".join(p.read_text() for p in sorted((tmp_path / "rss").glob("part-*"))).splitlines()
    assert len(lines) == 32 and lines[0].startswith("<rss") and lines[-1].endswith("</rss>")
    days = [line.split("<pubDate>")[1][5:7] for line in lines[1:-1]]
    assert days == sorted(days, reverse=True)


def test_yaml_records(spark):
    body = """# top
"A b":  # named
  url: https://x/#a
  note: 'it: is # here'   # mark

'C':
  - name: ["x", "y"]
    at: 1
  - name: z
plain: top
D:
  url:
"""
    rows = spark.createDataFrame([(1, body), (2, None), (3, ""), (4, "- at: 1\n  by: x\n- at: 2")], "id long, body string")
    got = {(r.id, r.name, r.item, r.field): r.value for r in tables.yaml_records(rows, "id", "body").collect()}
    want = {("A b", 0, "url"): "https://x/#a", ("A b", 0, "note"): "it: is # here", ("C", 1, "name"): '["x", "y"]', ("C", 1, "at"): "1", ("C", 2, "name"): "z"}
    listed = {(4, None, 1, "at"): "1", (4, None, 1, "by"): "x", (4, None, 2, "at"): "2"}
    assert got == {(1, *k): v for k, v in want.items()} | listed
    assert tables.yaml_records(rows.limit(0), "id", "body").count() == 0


def test_scratch_folders_go(spark):
    path = tables.scratch_folder(spark, "x")
    spark.range(3).write.parquet(path)
    assert spark.read.parquet(path).count() == 3
    tables.clear_scratch()
    assert not os.path.exists(path.removeprefix("file:"))


def test_a_broken_json_document_fails(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"n": 1},\n {"n": 2}]')
    (tmp_path / "b.json").write_text('{\n"n": 3}')
    assert sorted(r.n for r in tables.json_documents(spark, str(tmp_path), "n long").collect()) == [1, 2, 3]
    (tmp_path / "c.json").write_text('{"n": ')
    with pytest.raises(Exception, match="(?i)malformed"):
        tables.json_documents(spark, str(tmp_path), "n long").collect()
