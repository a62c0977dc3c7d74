import random
import re

from lakeloom.llm.decontamination import decontaminate


def cut(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def sh(t, k):
    w = cut(t)
    return {" ".join(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def test_matches_brute_force(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(40)] + ["É", "ß"]
    text = lambda n: " ".join(rng.choice(vocab) + rng.choice(["", "", ",", ".\n"]) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 3, 4, 5, 12, 30, 60]))) for i in range(25)] + [(99, None), (98, "")]
    docs = []
    for d in range(80):
        parts = [text(rng.randint(0, 300))]
        if rng.random() < 0.6:
            w = (rng.choice(items)[1] or "").split(" ")
            for _ in range(rng.randint(0, 3)):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocab)
            parts += [" ".join(w).upper(), text(rng.randint(0, 40))]
        docs.append((d, " ".join(parts)))
    docs += [(500, None), (501, ""), (None, items[3][1]), (7, docs[7][1])]
    want = set()
    for d, t in docs:
        for i, u in items:
            k = min(5, len(cut(u)))
            q = sh(u, k)
            n = len(q & sh(t, k))
            if d is not None and q and n / len(q) >= 0.8:
                want.add((d, i, len(q), n))
    got = decontaminate(spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, h string, item_id int").repartition(4), spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, doc_id string"))
    rows = got.collect()
    assert len(rows) == len(want) and {(r.doc_id, r.item_id, r.n_item, r.n_shared) for r in rows} == want
    assert want and all(r.containment == r.n_shared / r.n_item for r in rows)


def test_empty(spark):
    docs, items = "doc_id long, text string", "item_id long, text string"
    assert decontaminate(spark.createDataFrame([], docs), spark.createDataFrame([(1, "a b c d e f")], items)).count() == 0
    assert decontaminate(spark.createDataFrame([(1, "a b c d e f")], docs), spark.createDataFrame([], items)).count() == 0


def test_short_items_and_very_long_texts(spark):
    long = " ".join(f"v{i * i}" for i in range(200_000))
    docs = [(1, f"{long} one two three {long}"), (2, "One, two, THREE!"), (3, "one two"), (4, "x" * 2_000_000), (5, "one two four three")]
    items = [(7, "one two three"), (8, "two"), (9, "!?"), (10, None)]
    got = decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == [(1, 7), (1, 8), (2, 7), (2, 8), (3, 8), (5, 8)]
