import random
import re
from string import ascii_lowercase, ascii_uppercase

import pytest

from lakeloom.llm.license_scan import COVER, DRIFT, TEMPLATES, K, scan, spans, template_words

LOWER = str.maketrans(ascii_uppercase, ascii_lowercase)
NOTICE = TEMPLATES[5][2]


def rows():
    rng = random.Random(3)
    filler = ["the", "license", "mit", "under", "version", "2", "apache", "cc", "by", "nc", "éà", "software", "granted", "Is", "x9"]
    texts = [" ".join(rng.choice(filler) for _ in range(rng.choice([0, 1, 2, 3, 40, 300]))) for _ in range(60)]
    cut = NOTICE.split()
    texts += ["Released UNDER the MIT-License. cc.by/nc", None, "", " \n", NOTICE, "a b " + NOTICE.upper() + " c", " ".join(cut[:30] + ["really", "and", "truly"] + cut[30:]), " ".join(cut[:20]), " ".join(cut[:10] + cut[14:]), ("under the mit license " * 3000), "under thé mit license", "word " * 50_000 + "cc by nc"]
    return list(enumerate(texts)) + [(7, "cc by nc"), (None, "apache license version 2"), (None, None)]


def expected(doc_id, text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    places, base, labels, score = [], set(), set(), 0.0
    for label, is_base, template in TEMPLATES:
        t = template_words(template)
        if is_base and (found := [i for i in range(len(w) - len(t) + 1) if w[i : i + len(t)] == t]):
            places += found
            base.add(label)
        where = {}
        for i in range(len(t) - K + 1):
            where.setdefault(tuple(t[i : i + K]), []).append(i)
        diagonals = {}
        for p in range(len(w) - K + 1):
            for at in where.get(tuple(w[p : p + K]), ()):
                diagonals.setdefault(p - at, set()).update(range(at, at + K))
        last, seen = None, set()
        for d in sorted(diagonals):
            seen = seen | diagonals[d] if last is not None and d - last <= DRIFT else diagonals[d]
            last = d
            score = max(score, len(seen) / len(t))
            if len(seen) / len(t) >= COVER:
                labels.add(label)
    return (doc_id, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score)


def test_matches_brute_force(spark):
    data = rows()
    df = spark.createDataFrame([(d, t, "a", 1, "b") for d, t in data], "doc_id long, text string, words string, row int, hash string").repartition(5)
    got = sorted((tuple(r) for r in scan(df).collect()), key=str)
    assert got == sorted((expected(d, t) for d, t in data), key=str)


def test_a_notice_with_words_put_in_or_left_out_is_one_span(spark):
    cut = NOTICE.split()
    texts = ["a b " + " ".join(cut[:30] + ["really", "truly"] + cut[30:]), " ".join(cut[:30] + cut[32:])]
    got = spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).filter("template = 5").orderBy("doc_id").collect()
    n = len(template_words(NOTICE))
    assert [(r.start, r.stop) for r in got] == [(2, 4 + n), (0, n - 2)] and all(r.covered >= n - 6 for r in got)


def test_short_template_is_refused(spark):
    with pytest.raises(ValueError):
        scan(spark.createDataFrame([(1, "a")], "doc_id long, text string"), [("x", True, "two words")])


def test_empty(spark):
    assert scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
