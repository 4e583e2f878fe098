import random
import time
from fractions import Fraction
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest

from frameops.llm import periodic_runs as P
from frameops.llm import queries


def plain_runs(words):
    """All runs, by trying every period and every stretch."""
    n, found = len(words), []
    for period in range(1, n // 3 + 1):
        start = None
        for i in range(period, n + 1):
            same = i < n and words[i] == words[i - period]
            if same and start is None:
                start = i - period
            if not same and start is not None:
                own = words[start:i]
                if len(own) >= max(24, 3 * period) and all(own[p:] != own[:-p] for p in range(1, period)):
                    found.append((start, len(own), period))
                start = None
    return sorted(found, key=lambda r: (r[0], r[2]))


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def made(rng, n):
    """Texts with runs: random, one period, runs of all sizes in a row, runs inside a period, nested, almost constant."""
    letters = rng.choice([2, 3, 50])
    word = lambda: rng.randrange(letters)
    kind = rng.randrange(7)
    if kind == 0:
        return [word() for _ in range(n)]
    if kind == 1:
        own = [word() for _ in range(rng.randrange(1, n // 2 + 2))]
        return (own * n)[:n]
    if kind == 2:
        return fibonacci(n)
    out = []
    if kind == 3:
        while len(out) < n:
            own = [word() for _ in range(rng.randrange(1, 60))]
            out += (own * rng.randrange(1, 9))[: rng.randrange(1, 200)]
    elif kind == 4:
        own = [word() for _ in range(rng.randrange(20, max(21, n // 3)))]
        first = rng.randrange(len(own))
        step = rng.randrange(1, 10)
        for i in range(first, rng.randrange(first, len(own) + 1)):
            own[i] = own[first + (i - first) % step]
        out = [word() for _ in range(rng.randrange(20))] + own * (n // len(own) + 1)
    elif kind == 5:
        out = [0]
        while len(out) < n:
            out = out * rng.randrange(1, 5) + [word() for _ in range(rng.randrange(4))]
    else:
        out = [0] * n
        out[rng.randrange(n)] = 1
    return out[:n]


@pytest.mark.parametrize("together", [100, 1000, 200_000])
def test_runs_equal_brute_force(monkeypatch, together):
    monkeypatch.setattr(P, "TOGETHER", together)
    rng = random.Random(together)
    for _ in range(60):
        texts = [made(rng, rng.randrange(1, 500)) for _ in range(4)]
        for text, runs in zip(texts, P.find_runs([np.array(t) for t in texts])):
            assert [tuple(r) for r in runs.tolist()] == plain_runs(text), text


def test_long_periods_in_long_texts():
    rng = random.Random(4)
    for period in (47, 48, 49, 88, 89, 1000, 33_333):
        own = [rng.randrange(1000) for _ in range(period)]
        for length in (3 * period - 1, 3 * period, 3 * period + 1):
            text = [-1 + 2000, *(own * 4)[:length], 2001, 2002]
            (runs,) = P.find_runs([np.array(text)])
            assert [tuple(r) for r in runs.tolist()] == ([(1, length, period)] if length >= 3 * period else [])


@pytest.mark.parametrize("text", [
    lambda n: [0] * n, fibonacci, lambda n: ([0] * 1000 + [1] + list(range(2, 300))) * (n // 1299), lambda n: [0] * (n // 2) + [1] + [0] * (n // 2)])
def test_time_grows_with_the_text(text):
    """Texts in which nearly all grams are equal; all pairs of places would be 10^11."""
    start = time.time()
    P.find_runs([np.array(text(500_000))])
    assert time.time() - start < 30


def test_kept_words():
    runs = np.array([(2, 30, 4), (20, 30, 10)])
    assert P.kept_words(55, runs).tolist() == [*range(6), *range(50, 55)]
    assert P.kept_words(3, np.zeros((0, 3), dtype=np.int64)).tolist() == [0, 1, 2]


def planted(doc_id, words):
    h = crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_query_equals_brute_force(spark, document_rows):
    got = {r.doc_id: tuple(r)[1:] for r in queries.op12_periodic_runs(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(document_rows)
    some = 0
    for i, text in document_rows:
        words = planted(i, (text or "").encode().split())
        if len(words) > 1500:
            continue
        runs = plain_runs(words)
        some += len(runs)
        dropped = {k for s, n, q in runs for k in range(s + q, s + n)}
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        kept = b" ".join(w for k, w in enumerate(words) if k not in dropped)
        want = (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
                sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(), sha256(kept).hexdigest())
        assert got[i] == want, i
    assert some > 10


def test_runs_and_collapsed_texts(spark):
    docs = spark.createDataFrame([(1, "x y\x1c" + " go  on\tand" * 9 + "\nend é"), (2, "plain text")], "doc_id long, text string")
    assert [tuple(r) for r in P.runs(docs).collect()] == [(1, 2, 27, 3)]
    assert {r.doc_id: r.text for r in P.collapse(docs).collect()} == {1: "x y\x1c go on and end é", 2: "plain text"}


def test_awkward_rows(awkward, nothing):
    rows = P.digest(awkward).collect()
    assert len(rows) == awkward.count()
    empty = sha256(b"").hexdigest()
    assert all(tuple(r)[1:] == (0, None, None, None, None, empty, empty) for r in rows if r.doc_id in (1, 2, 3))
    assert P.collapse(awkward).count() == len(rows) and P.runs(awkward).count() >= 0
    for operator in (P.digest, P.collapse, P.runs):
        assert operator(nothing).collect() == []
