import random
import zlib
from hashlib import sha256
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.llm.merkle_manifest import FAN, Block, address, fold, manifest, size, tiers

LOWER = str.maketrans(ascii_uppercase, ascii_lowercase)
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf int, tree string, at string"


def h(parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return h("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def siblings(tree, at):
    for level in tree[:-1]:
        first = at - at % 16
        yield level[first:at], level[at + 1 : first + 16]
        at //= 16


def expected(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0], leaf(*r), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s, held in groups.items():
        held.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = levels([x[1] for x in held])
    top = levels([trees[s][-1][0] for s in order])
    root, out = top[-1][0], []
    for at_source, s in enumerate(order):
        for at, (doc_id, own, r) in enumerate(groups[s]):
            path = [*siblings(trees[s], at), *siblings(top, at_source)]
            bad = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
            folded = leaf(*r[:4], r[4] and r[4].translate(LOWER)) if bad else own
            for left, right in path:
                folded = h([*left, folded, *right])
            out.append((doc_id, own, trees[s][-1][0], root, h(x for pair in path for side in pair for x in side), folded, folded == root))
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA).repartition(5)


def rows(sizes):
    rng = random.Random(len(sizes))
    out = []
    for s, n in sizes.items():
        for _ in range(n):
            out.append((rng.randrange(10**6), s, rng.choice([None, "en", "é"]), rng.choice([None, 3]), rng.choice([None, "", "Some Text", "lower", "ÄA", "x" * 5000])))
    return out


@pytest.mark.parametrize("most", [1, 2, 3])
def test_matches_brute_force(spark, most):
    data = rows({"a": 1, "b": 16, "c": 17, "d": 256, "e": 700, None: 5, "": 2, "é": 3, "Z": 33})
    data += [(5, "a", "en", 1, "Same"), (5, "a", "en", 1, "Same"), (5, "a", "en", 1, "Other"), (None, "a", None, None, None), (None, None, None, None, None)]
    got = sorted((tuple(r) for r in manifest(table(spark, data), most=most).collect()), key=str)
    assert got == expected(data)
    assert {r[6] for r in got} == {True, False}


def test_many_sources(spark):
    data = rows({f"s{i}": 1 for i in range(300)})
    assert sorted((tuple(r) for r in manifest(table(spark, data)).collect()), key=str) == expected(data)


def test_one_row_and_none(spark):
    one = [(3, "a", "en", 2, "Hi")]
    assert [tuple(r) for r in manifest(table(spark, one)).collect()] == expected(one)
    assert manifest(table(spark, [])).count() == 0


def test_tampering_with_any_row_is_seen(spark):
    data = [(i, f"s{i % 3}", "en", 1, "Text") for i in range(50)]
    assert not manifest(table(spark, data), F.lit(True)).filter("verified").count()
    assert manifest(table(spark, data), F.lit(False)).filter("verified").count() == 50


def test_layout_is_a_numbering_and_keeps_halves_together():
    for depth in range(1, 6):
        at = np.concatenate([address(depth, d, np.arange(FAN**d)) for d in range(depth)])
        assert sorted(at.tolist()) == list(range(size(depth)))
    # of four levels, the tree below node 5 of the third lies in one piece after the top
    tree = [int(address(4, 2, np.array([5]))[0]), *address(4, 3, np.arange(80, 96)).tolist()]
    assert tree == list(range(size(2) + 5 * size(2), size(2) + 6 * size(2)))


def test_tiers_are_halves_of_halves():
    assert [tiers(e, 2) for e in (0, 1, 2, 3, 4, 5, 8)] == [[0], [1], [2], [2, 1], [2, 2], [2, 1, 2], [2, 2, 2, 2]]
    assert all(sum(tiers(e, m)) == e and max(tiers(e, m)) <= m for e in range(1, 16) for m in (1, 2, 3, 4))


def test_block_paths_fold_to_its_root():
    names = [h([str(i)]) for i in range(300)]
    b = Block.build(3, names)
    assert all(fold(n, p) == b.root() for n, p in zip(names, b.paths(), strict=True))
    assert b.root() == h([levels(names)[2][0], levels(names)[2][1]]) == levels(names)[-1][0]
