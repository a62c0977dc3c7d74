"""License notices in documents, found by diagonal voting against a table of templates.

Every run of K words of a document is hashed and joined by Spark to the positions of the same runs
in the templates. A hit votes for the diagonal `place in the document - place in the template`; the
votes of a diagonal are counted, diagonals that lie close together are merged (words put in or left
out move the rest of a notice to the next diagonal), and the merged span is verified by the share
of the template's words that its exactly equal runs cover.

The template table is a Python list, so it is broadcast with a known bound (`MOST_WORDS`). Hits are
few beside the words of the documents: they alone are shuffled, once, by row. One document's hits
are the largest group.

Defined cases: a null text is empty; a document without words gives zero counts, no places, empty
labels and score 0. Rows that share a doc_id, or lack one, are judged each on their own and all
stay. Of the input, only doc_id and text are read, so other columns may have any name. An empty
table gives an empty result. Words are compared after lower-casing A-Z only.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words of a run; diagonals this far apart are merged; share of a template's words that must be covered.
K = 3
DRIFT = 3
COVER = 0.8
#: Words of all templates together, at most: the table is broadcast.
MOST_WORDS = 1_000_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Fixed values: (label, base phrase or not, text) of phrases and of common license notices.
TEMPLATES: list[tuple[str, bool, str]] = [
    ("mit", True, "under the mit license"),
    ("apache-2", True, "apache license version 2"),
    ("cc-by-nc", True, "cc by nc"),
    ("gpl-3", False, "licensed under the GNU General Public License, version 3"),
    ("gpl-3", False, "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("mit", False, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("apache-2", False, "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2", False, "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("bsd", False, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", False, "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl-2", False, "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("cc-by-nc", False, "licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
    ("unlicense", False, "This is free and unencumbered software released into the public domain"),
]


def template_words(text: str) -> list[str]:
    return re.findall(WORD, text.translate(str.maketrans(_UPPER, _LOWER)))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(WORD), F.lit(0))


def _positions(docs: DataFrame, templates: list[tuple[str, bool, str]], k: int) -> DataFrame:
    """(hash, t0 ..., template, at): the runs of all templates, and the run of a document's header row (template -1)."""
    rows = [("", ) * k + (-1, -1)]
    for n, (_, _, text) in enumerate(templates):
        w = template_words(text)
        if len(w) < k:
            raise ValueError(f"a template needs {k} words at least: {text!r}")
        rows += [(*w[i : i + k], n, i) for i in range(len(w) - k + 1)]
    if len(rows) > MOST_WORDS:
        raise ValueError(f"templates have more than {MOST_WORDS} words")
    table = docs.sparkSession.createDataFrame(rows, ", ".join([*(f"t{j} string" for j in range(k)), "template int, at int"]))
    return table.withColumn("t_hash", F.xxhash64(*(f"t{j}" for j in range(k))))


def _votes(docs: DataFrame, templates: list[tuple[str, bool, str]], k: int) -> DataFrame:
    """(row, doc_id, n_words, place, template, at): header rows, and every run that equals one of a template."""
    listed = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id"), words(F.col("text")).alias("words")).withColumn("n_words", F.size("words").cast("long"))
    runs = listed.select("row", "doc_id", "n_words", "words", F.explode(F.sequence(F.lit(-1), F.greatest(F.lit(-1), (F.col("n_words") - k).cast("int")))).alias("place"))
    runs = runs.select("row", "doc_id", "n_words", "place", *(F.when(F.col("place") >= 0, F.get("words", F.col("place") + j)).otherwise("").alias(f"w{j}") for j in range(k)))
    runs = runs.withColumn("hash", F.xxhash64(*(f"w{j}" for j in range(k))))
    same = F.col("hash") == F.col("t_hash")
    for j in range(k):
        same &= F.col(f"w{j}") == F.col(f"t{j}")
    return runs.join(F.broadcast(_positions(docs, templates, k)), same).select("row", "doc_id", "n_words", "place", "template", "at")


def spans(docs: DataFrame, templates: list[tuple[str, bool, str]] = TEMPLATES, k: int = K, drift: int = DRIFT) -> DataFrame:
    """(row, doc_id, n_words, template, start, stop, covered, full): merged diagonals of each row and template.

    start and stop (exclusive) are word places; covered counts the template's words under equal
    runs; full lists the places where the whole template stands without a change. Each row also has
    a header, with template -1.
    """
    sizes = F.array(*(F.lit(len(template_words(t))) for _, _, t in templates))
    votes = _votes(docs, templates, k).repartition("row").withColumn("diagonal", F.col("place") - F.col("at"))
    one = votes.groupBy("row", "template", "diagonal").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.collect_list("at").alias("ats"))
    along = Window.partitionBy("row", "template").orderBy("diagonal")
    one = one.withColumn("new", F.when(F.col("diagonal") - F.lag("diagonal").over(along) <= drift, 0).otherwise(1)).withColumn("group", F.sum("new").over(along))
    whole = F.when(F.size("ats") == F.get(sizes, "template") - k + 1, F.col("diagonal").cast("long"))
    merged = one.groupBy("row", "template", "group").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("ats"),
        F.min(F.col("diagonal") + F.array_min("ats")).cast("long").alias("start"), F.max(F.col("diagonal") + F.array_max("ats") + k).cast("long").alias("stop"), F.collect_list(whole).alias("full"),
    )
    covered = F.aggregate("ats", F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")), lambda s, a: F.struct((s["n"] + a + k - F.greatest(a, s["to"])).alias("n"), (a + k).alias("to")))["n"]
    return merged.select("row", "doc_id", "n_words", "template", "start", "stop", covered.alias("covered"), "full")


def scan(docs: DataFrame, templates: list[tuple[str, bool, str]] = TEMPLATES, k: int = K, drift: int = DRIFT, cover: float = COVER) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), a row for each document.

    Base columns tell of the places where a base phrase stands unchanged; labels also has those of
    every template of whose words a span covers a share of `cover` or more; score is the largest
    share that any span covers.
    """
    at = lambda values: F.get(F.array(*map(F.lit, values)), F.col("template"))
    real = F.col("template") >= 0
    rows = spans(docs, templates, k, drift).withColumns({"label": at([t[0] for t in templates]), "base": F.coalesce(at([t[1] for t in templates]), F.lit(False)), "share": F.when(real, F.col("covered") / at([len(template_words(t[2])) for t in templates])).otherwise(0.0)})
    rows = rows.withColumn("places", F.when(F.col("base"), F.col("full")).otherwise(F.array().cast("array<bigint>")))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return rows.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.sum(F.size("places")).alias("n_base"), F.min(F.array_min("places")).alias("first_word"), F.max(F.array_max("places")).alias("last_word"),
        joined(F.when(F.size("places") > 0, F.col("label"))).alias("base_labels"), joined(F.when(real & (F.col("share") >= cover), F.col("label"))).alias("labels"), F.max("share").alias("score"),
    ).drop("row")
