import hashlib
import random

import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

from lakeloom.llm.sentencepiece_codec import WordTable, codec, digests

P = pytest.importorskip("public_tokenizers")
PATH = P.path("piece_bpe_32k.model")


def expected(text):
    import sentencepiece

    m = expected.model = getattr(expected, "model", None) or sentencepiece.SentencePieceProcessor(model_file=PATH)
    ids = m.encode(text or "")
    return ids, m.decode(ids)


TABLE = WordTable(PATH)


@example("a ")
@example("a  ")
@example(" ")
@example("  a\n \n")
@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" ▁\n\t\x00 ab19éß日本\U0001f600"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_words_alone_equal_whole(text):
    words = TABLE.split(text)
    TABLE.learn(set(words))
    rows = [TABLE.known[w] for w in words]
    assert ([i for r in rows for i in r[0]], "".join(r[2] for r in rows)[1:]) == expected(text)


def test_table(spark):
    rng = random.Random(2)
    data = [(i, "".join(rng.choice(["a", " ", "the ", "\n", "é", "Zz", "12"]) for _ in range(rng.choice([0, 5, 3000])))) for i in range(40)]
    data += [(90, None), (91, ""), (92, " "), (93, "x" * 50_000), (94, "x"), (94, "x")]
    df = spark.createDataFrame([(*r, 1) for r in data], "doc_id long, text string, ids int").repartition(3)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = sorted((d, len(ids), sha(",".join(map(str, ids))), sha(back)) for d, t in data for ids, back in [expected(t)])
    assert sorted(tuple(r) for r in digests(df, PATH).collect()) == want
    whole = codec(df, PATH).collect()
    assert sorted(tuple(r)[:4] for r in whole) == want
    assert all(r.decoded == (dict(data)[r.doc_id] or "") for r in whole)
    assert digests(df.limit(0), PATH).count() == 0
