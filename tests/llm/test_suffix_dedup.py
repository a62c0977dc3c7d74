import hashlib
import random
from collections import Counter

from lakeloom.llm.suffix_dedup import suffix_dedup


def brute(rows, window):
    docs = [(d, (t or "").encode()) for d, t in rows]
    n = Counter(b[s : s + window] for _, b in docs for s in range(len(b) - window + 1))
    out = []
    for d, b in docs:
        gone = set()
        for s in range(len(b) - window + 1):
            if n[b[s : s + window]] > 1:
                gone.update(range(s, s + window))
        spans = sum(1 for i in gone if i - 1 not in gone)
        out.append((d, len(b), len(gone), spans, hashlib.sha256(bytes(c for i, c in enumerate(b) if i not in gone)).hexdigest()))
    return sorted(out)


def corpus(seed, n=60):
    rng = random.Random(seed)
    rand = lambda k: "".join(rng.choice("abcde é\n") for _ in range(k))
    passages = [rand(rng.randint(20, 200)) for _ in range(5)]
    rows = []
    for d in range(n):
        parts = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            cut = rng.randint(0, len(p) // 3)
            parts.append(p[cut:] if rng.random() < 0.6 else rand(rng.randint(0, 90)))
        rows.append((d, "".join(parts)))
    return rows + [(1001, None), (1002, ""), (1003, "a" * 300), (1004, "ab" * 90), (1005, rows[3][1]), (1006, rows[3][1])]


def test_matches_brute_force(spark):
    for seed, window, gram, hot in ((1, 40, 8, 20_000), (2, 64, 8, 3), (3, 33, 32, 2)):
        rows = corpus(seed)
        df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, pos int, key string").repartition(5)
        got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup(df, window, gram, hot).collect())
        assert got == brute(rows, window), (seed, window)


def test_empty_null_and_repeated_rows(spark):
    schema = "doc_id long, text string"
    assert suffix_dedup(spark.createDataFrame([], schema)).count() == 0
    text = "".join(chr(97 + i * i % 23) for i in range(900))
    got = suffix_dedup(spark.createDataFrame([(5, text), (5, text), (None, "ab")], schema)).collect()
    assert sorted((r.doc_id or -1, r.n_bytes - r.n_removed) for r in got) == [(-1, 2), (5, 0), (5, 0)]


def test_passages_of_over_fifty_words_go_from_400_bytes_on(spark):
    rng = random.Random(9)
    prose = lambda k: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(k))
    rows, size = [], {}
    for p, n in enumerate((340, 394, 399, 400, 450)):
        passage = prose(120)[:n]
        assert len(passage.split()) > 50
        for copy in range(4):
            doc = 10 * p + copy
            size[doc] = n
            rows.append((doc, f"{prose(60)}{copy}{passage}{copy}{prose(60)}"))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup(df).collect())
    assert got == brute(rows, 400)
    assert {doc: gone for doc, _, gone, _, _ in got} == {doc: n if n >= 400 else 0 for doc, n in size.items()}
