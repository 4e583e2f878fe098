import random
from collections import Counter
from fractions import Fraction

import numpy as np

from conftest import words
from frameops.llm import minhash_dedup as M, shingles as S
from frameops.llm.components import components


def plain(rows, over=17, under=20):
    """Set sizes and smallest reachable ids, by comparing all pairs."""
    sets = {}
    for i, text in rows:
        own = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        own = [w for w in own.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
        sets[i] = {tuple(own[k:k + 5]) for k in range(len(own) - 4)} if len(own) >= 5 else {tuple(own)} if own else set()
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            if sets[a] and sets[b] and under * len(sets[a] & sets[b]) >= over * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {(i, len(sets[i]), top(i), top(i) == i) for i in ids}


def near_copies(n, seed, size=60, edits=4):
    """Texts made from one text by changing a few words each."""
    rng = random.Random(seed)
    base = words(size, seed).split()
    out = []
    for k in range(n):
        own = list(base)
        for _ in range(rng.randrange(edits)):
            own[rng.randrange(size)] = f"x{seed}_{k}"
        out.append(" ".join(own))
    return out


def test_given_documents(documents, document_rows):
    got = {tuple(r) for r in M.near_duplicates(documents).collect()}
    assert got == plain(document_rows)


def test_near_copies(spark, monkeypatch):
    texts = near_copies(60, 1) + near_copies(40, 2, 200, 12) + near_copies(30, 3, 12, 2) + [words(50, s) for s in range(100, 140)]
    rows = list(enumerate(texts + texts[:20]))
    random.Random(4).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain(rows)
    assert {tuple(r) for r in M.near_duplicates(df).collect()} == want
    # buckets in many blocks give the same links
    monkeypatch.setattr(M, "BLOCK_SHINGLES", 500)
    assert {tuple(r) for r in M.near_duplicates(df).collect()} == want


def test_awkward_rows(awkward, nothing):
    rows = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in M.near_duplicates(awkward).collect())
    assert sum(rows.values()) == 13
    assert rows[(1, 0, 1, True)] == rows[(2, 0, 2, True)] == rows[(3, 0, 3, True)] == 1
    assert rows[(5, 26, 5, True)] == 2 and rows[(6, 26, 5, False)] == 1
    assert rows[(None, 1, None, True)] == 1 and rows[(None, 0, None, True)] == 1
    assert rows[(4, 1, 4, True)] == 1
    result = M.near_duplicates(nothing)
    assert result.collect() == [] and result.columns == ["doc_id", "n_shingles", "component_id", "kept"]


def test_one_of_each(awkward, nothing):
    kept = M.one_of_each(awkward)
    assert kept.columns == awkward.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 2, 3, None, None, 4, 5, 7, 8, 9, 10])
    assert M.one_of_each(nothing).collect() == []


def test_words_and_sets():
    texts = [b"A b\tC\x0bd  e f", b"", None, "Éa éa".encode(), b"x " * 700_000]
    hashed = S.word_hashes(texts)
    assert [len(h) for h in hashed] == [6, 0, 0, 2, 700_000]
    assert S.word_hashes([b"a B c d e f"])[0].tolist() == hashed[0].tolist()
    assert hashed[3][0] != hashed[3][1] and len(set(hashed[4].tolist())) == 1
    assert [len(s) for s in S.shingle_sets(texts, 5)] == [2, 0, 0, 1, 1]


def test_match_threshold_misses_few():
    rng = np.random.default_rng(0)
    for similarity in (Fraction(17, 20), Fraction(4, 5)):
        least = M.match_threshold(similarity)
        assert (rng.binomial(M.COORDINATES, float(similarity), 1_000_000) < least).mean() <= 2 * M.MISS


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 300)] + [(7, 7), (200, 101)]
    random.Random(1).shuffle(links)
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {**{i: 1 for i in range(1, 41)}, **{100 + i: 100 for i in range(300)}}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
