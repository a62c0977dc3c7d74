import numpy as np
import pyarrow as pa

from lakeloom.llm import _kernel as K


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_word_hashes_and_spacing():
    texts = ["ab  abc\tab", "abcdefgh abcdefghi " + "x" * 100, "", None, "ab"]
    ((_, _, buf, offsets),) = list(K.pieces(pa.array(texts)))
    starts, stops, bounds = K.word_bounds(buf, offsets)
    h = K.word_hashes(buf, starts, stops)
    words = [buf[a:b].tobytes() for a, b in zip(starts, stops, strict=True)]
    assert bounds.tolist() == [0, 3, 6, 6, 6, 7]
    assert len({(w, x) for w, x in zip(words, h.tolist(), strict=True)}) == len(set(words)) == len(set(h.tolist()))
    data, new, end = K.single_spaced(buf, starts, stops)
    assert [data[a:b] for a, b in zip(new.tolist(), end.tolist(), strict=True)] == words
    assert data == b" ".join(words) + b" "


def test_words_that_polynomial_hashes_confuse_differ():
    a = thue_morse(2048)
    b = a.translate(str.maketrans("ab", "ba"))
    ((_, _, buf, offsets),) = list(K.pieces(pa.array([f"{a} {b} {a[:64]} {b[:64]}"])))
    starts, stops, _ = K.word_bounds(buf, offsets)
    assert len(np.unique(K.word_hashes(buf, starts, stops))) == 4
