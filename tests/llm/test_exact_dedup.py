import hashlib
import random
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import functions as F

from lakeloom.llm.exact_dedup import exact_dedup

LOWER = str.maketrans(ascii_uppercase, ascii_lowercase)


def rows():
    rng = random.Random(5)
    texts = ["".join(rng.choice("abE S\né") for _ in range(rng.choice([0, 3, 700, 9000]))) for _ in range(20)]
    out = [(i, rng.choice(texts)) for i in range(60)]
    return out + [(100, None), (101, ""), (102, "ÉA"), (103, "Éa"), (104, "éa"), (105, "x" * 20000), (106, "X" * 20000), (None, "lonely")]


def expected(data):
    norm = [(d, (t or "").translate(LOWER)) for d, t in data]
    groups = {}
    for d, t in norm:
        groups.setdefault(t, []).append(d)
    out = []
    for d, t in norm:
        keep = max((x for x in groups[t] if x is not None), default=None)
        out.append((d, keep, len(groups[t]), d == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def test_matches_brute_force(spark):
    data = rows()
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in data], "doc_id long, text string, norm string, recipe int").repartition(5)
    for chunk_id in (None, lambda c: F.substring(F.sha2(c, 256), 1, 1)):  # the second clashes and falls back to contents
        got = exact_dedup(df, chunk_id) if chunk_id else exact_dedup(df)
        assert sorted((tuple(r) for r in got.collect()), key=str) == expected(data)


def test_empty(spark):
    assert exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
