import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lakeloom.llm import _subword as U
from lakeloom.llm.language_id import language
from lakeloom.llm.quality_classifier import keep_good, quality

SF = "/root/testdata/sf0.01"


def test_quality_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality(docs, labels).join(labels, "doc_id").collect()
    assert {r.held_out for r in rows} == {True, False}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    test = [r for r in rows if r.held_out]
    good, bad = [r.score for r in test if r.quality == 1], [r.score for r in test if r.quality == 0]
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.9
    assert sum(g >= 0.7 for g in good) / len(good) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_quality_never_reads_labels_of_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet").limit(150), spark.read.parquet(f"{SF}/labels.parquet")
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 4 = 2 then 1 - quality else quality end as quality")
    one = {r.doc_id: r.score for r in quality(docs, labels, 60).collect()}
    assert one == {r.doc_id: r.score for r in quality(docs, flipped, 60).collect()}


def test_quality_edge_cases(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(80)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    texts = ["all is well here", "BAD!! BAD!!"]
    rows = [(i, texts[1 - i % 2] * (1 + i % 3), 0.5) for i in range(80)] + [(900, None, 0.5), (901, "", 0.5), (None, "x", 0.5), (902, "é " * 40_000, 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    got = quality(docs, labels)
    assert got.count() == len(rows) and got.filter("score is null or isnan(score)").count() == 0
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.filter("doc_id % 2 = 1 and doc_id < 80").count() == 40
    assert quality(docs, labels.limit(0)).filter("predicted = 1").count() == len(rows)
    assert quality(docs.limit(0), labels).count() == 0


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = language(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    test = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert sum(r.lang == r.lang_pred for r in test) / len(test) > 0.97
    sure = [r for r in test if r.accepted]
    assert sum(r.lang == r.lang_pred for r in sure) / len(sure) > 0.97


def test_language_edge_cases(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["the", "and", "of"] if i % 2 else ["der", "und", "nicht"]) for _ in range(20)), "en" if i % 2 else "de", 1) for i in range(60)]
    rows += [(900, None, "en", 1), (901, "", None, 1), (902, "12 345 _", "en", 1), (904, "\u00bd \u00b2 \u2167 3", "en", 1), (905, "der und nicht " * 100_000, None, 1), (903, "the and of", None, 1), (None, "und der", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = {r.doc_id: r for r in language(docs).collect()}
    assert [got[i].lang_pred for i in (900, 901, 902, 904, 905)] == ["und"] * 4 + ["de"] and got[902].score == 0
    assert got[903].lang_pred == "en" and got[None].lang_pred == "de" and got[None].held_out is False
    assert language(docs.limit(0)).count() == 0
    none = language(docs.selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()
    assert {r.lang_pred for r in none} == {"und"}


@pytest.mark.parametrize("label", [0, 1])
def test_one_label_only(spark, label):
    labels = spark.createDataFrame([(i, label) for i in range(20)], "doc_id long, quality int")
    docs = spark.createDataFrame([(i, "a b") for i in range(20)], "doc_id long, text string")
    assert quality(docs, labels).filter("score = 1").count() == 20


@pytest.mark.parametrize("names", [[0, 1], ["de", "en", "fr"]])
def test_scores_match_a_plain_loop(names):
    rng = random.Random(6)
    letters = ["a", "b", "é", "漢", " ", " ", "\n", "!"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 2, 3, 5, 60, 900]))) for _ in range(80)]
    texts += [None, "", "a", "a a", "word " * 150_000, "x" * 600_000]  # longer than a piece
    r = np.random.default_rng(2)
    model = U.SubwordModel(names, r.normal(size=(U.BUCKETS, len(names))).astype(np.float32), r.normal(size=len(names)), 1.7, r.normal(size=len(names)))
    got = model.probabilities(pa.array(texts, pa.string()))
    for text, row in zip(texts, got, strict=True):
        ids, shares = U.bag(text)
        z = [1.7 * (sum(float(w) * float(model.scores[i, k]) for i, w in zip(ids.tolist(), shares.tolist(), strict=True)) + model.bias[k]) + model.shift[k] for k in range(len(names))]
        e = [math.exp(x - max(z)) for x in z]
        assert np.allclose(row, [x / sum(e) for x in e], atol=1e-4)


def test_features_of_a_text_by_hand():
    text = "né né xy \n xy"
    b, words = text.encode(), text.split()
    mixed = lambda gram: ((int.from_bytes(gram, "big") & 0xFFFFFFFF) * int(U._MIX) & 0xFFFFFFFF) >> (32 - U.BITS)
    want = sorted([mixed(b[i : i + n]) + ((n - 2) << U.BITS) for n in (3, 4) for i in range(len(b) - n + 1)] + [3 << U.BITS] * sum(x == y for x, y in zip(words, words[1:], strict=False)))
    buf = np.frombuffer(b, np.uint8)
    (own, _), *rest = U.families(buf, np.array([0, len(b)]))
    assert sorted(np.concatenate([f for f, _ in rest]).tolist()) == want
    assert [own[i] == own[j] for i in range(4) for j in range(i)] == [words[i] == words[j] for i in range(4) for j in range(i)]
    two = list(U.families(np.frombuffer(b + b, np.uint8), np.array([0, len(b), 2 * len(b)])))
    assert all((np.diff(bounds) == np.diff(bounds)[0]).all() for _, bounds in two)


def test_repeated_rows_do_not_multiply_in_training(spark, monkeypatch):
    from lakeloom.llm import language_id, quality_classifier
    from lakeloom.llm._subword import SubwordModel

    fitted = []
    monkeypatch.setattr(SubwordModel, "fit", classmethod(lambda cls, texts, labels, **_: fitted.append((texts, labels))))
    monkeypatch.setattr(language_id, "rejection_level", lambda *_: 0.0)
    for one in (0, 1, 3, 4, 7):  # ids of any hash; one that is held out gives nothing
        rows = [(one, f"text {i % 3}", "en") for i in range(2000)] + [(100 + i, "ein Text", "de") for i in range(9)] + [(200, "x" * 60_000, "fr"), (9, None, "it")]
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        language_id.train(docs)
        texts, langs = fitted.pop()
        held = zlib.crc32(str(one).encode()) % 3 == 1
        assert (texts.count("text 0"), langs.count("en"), langs.count("fr"), langs.count("it")) == ((0 if held else 1), (0 if held else 1), 0, 0) and langs.count("de") > 3
    labels = spark.createDataFrame([(0, 1)] * 500 + [(0, 0)] * 500 + [(100, 0), (103, 0), (200, 0), (None, 1), (1, None)], "doc_id long, quality int")
    docs = spark.createDataFrame([(0, f"text {i % 3}") for i in range(2000)] + [(100, "ein Text"), (103, None), (200, "x" * 60_000)], "doc_id long, text string")
    quality_classifier.train(docs, labels)
    learned = [(i, t, q) for i, t, q in ((0, "text 0", 1), (100, "ein Text", 0), (103, "", 0)) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert len({q for *_, q in learned}) == 2 and sorted(zip(*fitted.pop(), strict=True)) == sorted((t, q) for _, t, q in learned)
