import hashlib
import random

from lakeloom.llm.substring_dedup import substring_dedup


def brute(rows, window):
    seen, out = {}, {}
    docs = {d: (t or "").encode().split() for d, t in rows}
    for d in sorted(docs):
        words = docs[d]
        gone = set()
        for s in range(len(words) - window + 1):
            key = tuple(words[s : s + window])
            if key in seen:
                gone.update(range(s, s + window))
            else:
                seen[key] = (d, s)
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out[d] = (len(words), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed, n=90):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)] + ["é", "ß", "the", "a"]
    passages = [[rng.choice(vocab) for _ in range(rng.randint(8, 60))] for _ in range(6)]
    rows = []
    for d in range(n):
        words = []
        for _ in range(rng.randint(0, 5)):
            words += rng.choice(passages) if rng.random() < 0.5 else [rng.choice(vocab[:3]) for _ in range(rng.randint(0, 50))]
        rows.append((d * 3, rng.choice([" ", "\n", "  ", "\t"]).join(words)))
    rows += [(1, None), (2, ""), (4, "one"), (7, "x " * 400), (8, "x " * 30), (10, "nbsp inside stays")]
    return rows


def test_matches_brute_force(spark):
    for seed, window, batches in ((1, 20, 2), (2, 7, 4), (3, 20, 1)):
        rows = corpus(seed)
        df = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], "doc_id long, text string, fp string, pos int").repartition(5)
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(df, window, batches).collect()}
        assert got == brute(rows, window)


def test_empty_table_and_repeated_rows(spark):
    schema = "doc_id long, text string"
    assert substring_dedup(spark.createDataFrame([], schema)).count() == 0
    text = " ".join(f"w{i}" for i in range(50))
    got = substring_dedup(spark.createDataFrame([(5, text), (5, text), (None, "a b")], schema)).collect()
    assert sorted((r.doc_id or -1, r.n_removed) for r in got) == [(-1, 0), (5, 0), (5, 0)]


def test_words_are_compared_not_their_hashes(spark):
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))  # polynomial hashes take it for its complement
    b = a.translate(str.maketrans("ab", "ba"))
    around = [f"w{i}" for i in range(30)]
    rows = [(1, " ".join([*around[:15], a, *around[15:]])), (2, " ".join([*around[:15], b, *around[15:]]))]
    got = {r.doc_id: r.n_removed for r in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 0}


def test_very_long_texts(spark):
    words = [f"v{i * i}" for i in range(120_000)]
    rows = [(1, " ".join(words)), (2, "x" * 3_000_000), (3, "lead " + " ".join(words[50_000:110_000])), (4, "y" * 3_000_000 + " end")]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (120_000, 0), 2: (1, 0), 3: (60_001, 60_000), 4: (2, 0)}


def test_old_runs_are_joined_without_exchange(spark):
    from lakeloom.llm import substring_dedup as S
    from lakeloom.llm._stage import _BUCKETS, configured

    index = S.FingerprintIndex(spark, 5, 3)
    rows = [(i, " ".join(f"w{(i * 7 + k) % 50}" for k in range(40))) for i in range(40)]
    for part in (rows[:20], rows[20:]):
        index.add(spark.createDataFrame(part, "doc_id long, text string"))
    a, b = index.runs
    joined = a.join(b.select(*S.W.SAME, "copies").withColumnRenamed("copies", "more").hint("merge"), S.W.SAME)
    with configured(spark, _BUCKETS):
        plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "+- Sort " not in plan
