"""Quote marks of long lines."""

import time

from pyspark.sql import functions as F

from lakeloom.operators import positional


def _flags(line):
    out, inside = [], False
    for c in line:
        out.append(inside)
        inside ^= c == '"'
    return out


def test_flags_and_counts_of_lines(spark):
    lines = ['a"b"', '"', '""', 'xy', '"é😀"z"', 'end"', 'a\r"b\r', '"' * 7, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "id int, line string").repartition(1)
    got = df.select("id", positional.quoted(F.col("line"), positional.characters(F.col("line"))).alias("q"), positional.quoted_count(F.col("line")).alias("n")).collect()
    assert [r.q for r in got] == [_flags(t) for t in lines]
    assert [r.n for r in got] == [sum(_flags(t)) for t in lines]


def test_time_in_proportion_to_a_line(spark):
    """The marks were cut anew for each piece: a line of 100,000 took minutes."""
    n = 100_000
    df = spark.range(1).select(F.repeat(F.lit('"a'), n).alias("line")).repartition(1)
    t = time.time()
    (row,) = df.select(F.size(F.filter(positional.quoted(F.col("line"), F.col("line")), lambda q: q)).alias("flags"), positional.quoted_count(F.col("line")).alias("n")).collect()
    assert (row.flags, row.n) == (n, n) and time.time() - t < 30


def test_rings_and_glyphs_of_odd_lines(spark):
    """Characters of several bytes, lines of other lengths, missing lines, lone letters and v."""
    lines = {1: ["é😀z", "ab", "", "x" * 5], 2: ["v vv av a1b \tc"]}
    df = spark.createDataFrame([(k, y, t) for k, ts in lines.items() for y, t in enumerate(ts) if t], "id long, y int, line string").repartition(1)
    got = {(r.id, r.y): (r.ch, r.ring) for r in positional.around(df, "id").collect()}
    assert set(got) == {(1, 0), (1, 1), (1, 3), (2, 0)}
    for (k, y), (ch, ring) in got.items():
        line = lines[k]
        at = lambda i, x: line[i][x] if 0 <= i < len(line) and 0 <= x < len(line[i]) else " "  # noqa: B023, E731
        assert ch == list(line[y])
        assert ring == ["".join(at(y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dx or dy) for x in range(len(line[y]))]
    texts = ["v vv av a1b \tc", "ab\nc\n\nvd é", "", None]
    counts = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string").repartition(1).select(positional.glyph_counts(F.col("t")).alias("n")).collect()
    assert [tuple(r.n[k] for k in ("text", "space", "glyph")) for r in counts] == [(1, 4, 9), (3, 1, 3), (0, 0, 0), (None, None, None)]


def _operators(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lines_meet_as_texts_and_glyphs_are_not_exploded(spark, tmp_path):
    """Arrays of all characters were dealt out for the neighbours, and a row was made of each character for the glyphs."""
    from lakeloom.plans import catalogue

    q = catalogue.queries()
    plan = _operators(q["neighbours"](spark, "/root/testdata/sf0.001"))
    assert "filter(split" not in plan.split("Window", 1)[1]
    assert "explode" not in _operators(q["glyph_classes"](spark, "/root/testdata/sf0.001"))


def test_costly_rows_of_a_small_file_are_dealt_out(spark):
    """The table's file is one task however much work its rows are."""
    from lakeloom.plans import catalogue

    q = catalogue.queries()
    for name in ("num_format", "num_format_si", "num_format_types", "num_format_prefix", "bibtex_entries", "yaml_paths"):
        assert "Repartition 4, true" in _operators(q[name](spark, "/root/testdata/sf0.001")), name
