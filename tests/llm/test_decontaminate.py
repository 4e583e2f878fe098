import random
from collections import Counter

import numpy as np

from conftest import words
from frameops.llm import decontaminate as D, shingles as S


def plain(rows, items):
    """Items of which a text holds four fifths of the five-word shingles anywhere."""
    out = set()
    own = [(i, {tuple(t.lower().split()[k:k + 5]) for k in range(len(t.split()) - 4)}) for i, t in items]
    for i, text in rows:
        w = (text or "").lower().split()
        here = {tuple(w[k:k + 5]) for k in range(len(w) - 4)}
        out |= {(i, item) for item, need in own if len(need & here) >= 0.8 * len(need)}
    return out


def test_given_documents(documents, document_rows, table):
    items = table("benchmark")
    got = {(r.doc_id, r.item_id) for r in D.leaks(documents, items).collect()}
    assert got == plain(document_rows, [tuple(r) for r in items.collect()]) and got
    blocks = {(r.doc_id, r.item_id) for r in D.leaks(documents, items, index_items=7).collect()}
    assert blocks == got
    kept = D.uncontaminated(documents, items)
    assert kept.columns == documents.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in document_rows} - {i for i, _ in got}


def test_planted_passages(spark):
    items = [(k, words(40, 500 + k, 100_000)) for k in range(30)]
    rng = random.Random(2)
    rows, want = [], set()
    for i in range(120):
        text = words(rng.randrange(900), 9000 + i).split()
        if i % 3 == 0:
            item = rng.randrange(30)
            passage = items[item][1].split()
            if i % 2:
                passage[20] = "changed"
            at = rng.randrange(len(text) + 1)
            text[at:at] = passage
            want.add((i, item))
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = D.leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert all(r.overlap >= 0.8 and r.score >= 0.5 for r in got)


def test_questions_alone_and_changed_words(spark):
    items, rows, want = [], [], set()
    for k, n in enumerate(range(16, 29)):
        own = words(n, 700 + k, 100_000).split()
        items.append((k, " ".join(own)))
        question = D.halves(items[-1][1].encode())[0].decode()
        changed = [own[:at] + ["changed"] + own[at + 1:] for at in (n // 2, 1, n - 3)]
        for passage in (question, *(" ".join(c) for c in changed)):
            want.add((len(rows), k))
            rows.append((len(rows), f"{words(90, 2000 + len(rows))} {passage} {words(90, 4000 + len(rows))}"))
        rows.append((len(rows), f"{words(90, 2000 + len(rows))} {' '.join(own[-n // 3:])} {words(90, 4000 + len(rows))}"))
        rows.append((len(rows), f"{words(90, 2000 + len(rows))} {' '.join(sorted(own))} {words(90, 4000 + len(rows))}"))
    # the answer is most of the item
    items.append((99, f"{words(12, 801, 100_000)}? {words(60, 802, 100_000)}."))
    want.add((len(rows), 99))
    rows.append((len(rows), f"{words(90, 803)} {words(12, 801, 100_000)}? {words(90, 804)}"))
    docs, table = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in D.leaks(docs, table).collect()} == want
    assert {r.doc_id for r in D.uncontaminated(docs, table).collect()} == {i for i, _ in rows} - {i for i, _ in want}


def test_search_returns_all_above_the_threshold():
    rng = random.Random(7)
    items = [(i, " ".join(f"t{int(rng.paretovariate(0.6))}" for _ in range(30)).encode()) for i in range(400)]
    index = D.Index(items)
    for _ in range(60):
        text = " ".join(f"t{int(rng.paretovariate(0.6))}" for _ in range(80)).encode() + b" " + rng.choice(items)[1][:rng.randrange(120)]
        _, number = index.found(S.word_hashes([text])[0])
        terms = np.unique(number).tolist()
        scores = Counter()
        for t in terms:
            for item, impact in zip(index.postings[t].items, index.postings[t].impacts):
                scores[item] += impact
        for threshold in (0.05, 0.2, 0.5):
            want = {i for i, s in scores.items() if s >= threshold}
            assert {i for i, _ in index.search(terms, threshold)} == want


def test_awkward_rows(awkward, nothing, spark):
    items = spark.createDataFrame([(1, words(30, 2)), (2, None), (3, ""), (4, "one"), (5, words(30, 2))], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in D.leaks(awkward, items).collect())
    assert got == [(4, 4), (10, 1), (10, 5)]
    assert D.leaks(nothing, items).collect() == []
    assert D.leaks(awkward, items.filter("item_id > 99")).collect() == []
    assert D.uncontaminated(awkward, items).count() == 11 and D.uncontaminated(nothing, items).collect() == []


def test_halves():
    assert D.halves(b"Who? Me.") == (b"Who?", b"Me.")
    assert D.halves(b"a b c d e f") == (b"a b c d", b"e f")
