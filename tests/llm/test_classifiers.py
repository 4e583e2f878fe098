from collections import Counter

import numpy as np
import pytest

from frameops.llm import importance, licence_scan, toxicity

BIG = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def larger(spark):
    return lambda name: spark.read.parquet(f"{BIG}/{name}.parquet")


def texts(n, bad, seed=0):
    rng = np.random.default_rng(seed)
    words = [f"{a}{b}" for a in "ba de ki lo mu".split() for b in "ra se ti no pu ga".split()]
    out = []
    for i in range(n):
        own = list(rng.choice(words, 60))
        if bad(i):
            for _ in range(4):
                own[rng.integers(60)] = "zorg" + rng.choice(words)
        out.append((i, " ".join(own), int(bad(i))))
    return out


def test_toxicity_finds_unseen_forms(spark):
    rows = texts(1500, lambda i: i % 7 == 0)
    docs = spark.createDataFrame(rows, "doc_id long, text string, truth int")
    labels = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int")
    scored = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    truth = {i: t for i, _, t in rows}
    held = [r for r in scored if r.held_out]
    assert 200 < len(held) < 400
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in scored)


def test_toxicity_learns_nothing_from_held_out_labels(spark):
    rows = texts(600, lambda i: i % 7 == 0)
    docs = spark.createDataFrame(rows, "doc_id long, text string, truth int")
    labels = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int")
    wrong = labels.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 5 = 0, 1 - toxic, toxic) as toxic")
    one, two = (toxicity.fit(docs, x) for x in (labels, wrong))
    assert one.features == two.features and np.allclose(one.weights, two.weights)


def test_toxicity_on_given_labels(larger):
    docs, labels = larger("documents"), larger("labels")
    scored = {r.doc_id: r for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    judged = [(scored[r.doc_id], r.toxic) for r in labels.collect() if scored[r.doc_id].held_out]
    assert len(scored) == docs.count()
    assert np.mean([r.predicted == t for r, t in judged]) > 0.9
    assert not [r for r, t in judged if not t and r.predicted]


def test_label_model_counts_a_clique_of_voters_once():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.3
    good = np.stack([np.where(rng.random(4000) < 0.9, truth, ~truth) for _ in range(3)], axis=1)
    one = np.where(rng.random(4000) < 0.6, truth, ~truth)
    votes = np.column_stack([good, *[one] * 12]).astype(float)
    posterior, alpha, beta = toxicity.label_model(votes, good.mean(1) * 0.9 + 0.05)
    assert ((posterior > 0.5) == truth).mean() > 0.95
    assert np.allclose(alpha[:3], 0.9, atol=0.05) and np.allclose(beta[:3], 0.1, atol=0.05)


def test_toxicity_awkward_rows(awkward, nothing, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(awkward, none)
    got = toxicity.score(awkward, model).collect()
    assert len(got) == 13 and not any(r.predicted for r in got)
    assert toxicity.score(nothing, model).collect() == []
    insult = spark.createDataFrame([(1, "You IDIOT!"), (2, "you")], "doc_id long, text string")
    assert {r.doc_id: r.predicted for r in toxicity.score(insult, model).collect()} == {1: 1, 2: 0}
    assert toxicity.accepted(awkward, model).count() == 13 and toxicity.accepted(insult, model).count() == 1


def test_importance_parts_good_from_junk(larger):
    docs, labels = larger("documents"), larger("labels")
    ratio = importance.fit(docs, labels)
    got = {r.doc_id: r for r in importance.resample(docs, ratio).collect()}
    judged = [(got[r.doc_id].kept, r.quality) for r in labels.collect()]
    assert np.mean([k for k, q in judged if q]) > 0.95 and np.mean([k for k, q in judged if not q]) < 0.3


def test_importance_models_are_exact(documents, document_rows):
    counts = Counter()
    from frameops.llm import shingles as S
    for h in S.word_hashes([t.encode() for _, t in document_rows]):
        counts.update(importance.ngrams(h).tolist())
    dense = np.zeros(importance.BUCKETS)
    for b, n in counts.items():
        dense[b] = n
    want = np.log((dense + 0.5) / (dense.sum() + 0.5 * importance.BUCKETS))
    assert np.allclose(importance.model(documents.selectExpr("cast(text as binary) as text")), want)


@pytest.mark.parametrize("bits", [25, 16])
def test_importance_counts_all_good_documents(spark, monkeypatch, bits):
    from frameops.llm import sieve
    monkeypatch.setattr(sieve, "BITS", bits)
    docs = spark.range(31_000).selectExpr("id as doc_id", "concat('w', id, ' v', id % 7) as text")
    labels = docs.selectExpr("doc_id", "cast(doc_id < 21000 as int) as quality")
    ratio = importance.fit(docs, labels)
    good = importance.model(docs.filter("doc_id < 21000").selectExpr("cast(text as binary) as text"))
    raw = importance.model(docs.selectExpr("cast(text as binary) as text"))
    assert np.allclose(ratio.weights, good - raw, rtol=0, atol=1e-12) and ratio.share == 21 / 31


def test_kth_largest(spark):
    rng = np.random.default_rng(2)
    for values in (rng.normal(size=3000), np.round(rng.normal(size=3000), 1), np.zeros(50), np.array([1.0, 1.0, 5e-324, 0.0])):
        keys = spark.createDataFrame([(float(v),) for v in values], "key double")
        for k in (1, 2, len(values) // 3, len(values)):
            if k:
                assert importance.kth_largest(keys, k) == sorted(values, reverse=True)[k - 1]


def test_importance_awkward_rows(awkward, nothing, spark):
    labels = spark.createDataFrame([(5, 1), (9, 0), (None, 1)], "doc_id long, quality int")
    got = importance.resample(awkward, importance.fit(awkward, labels)).collect()
    assert len(got) == 13 and not any(r.kept for r in got if r.doc_id in (1, 2, 3))
    assert importance.resample(nothing, importance.fit(nothing, labels)).collect() == []
    none = importance.fit(awkward, labels.filter("quality > 1"))
    assert sum(r.kept for r in importance.resample(awkward, none).collect()) == 9


LINES = {"GPL": "This work is licensed under the GNU General Public License, version 3.", "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
         "CC-BY-NC": "Licensed under CC BY-NC 4.0.", "MIT": "Released under the MIT License.", "proprietary": "All rights reserved."}


def test_licences_of_given_documents(larger):
    docs = larger("documents")
    model = licence_scan.fit(docs)
    got = {r.doc_id: r for r in licence_scan.documents(docs, model).collect()}
    for r in docs.collect():
        assert got[r.doc_id].licences == ",".join(sorted(k for k, line in LINES.items() if line in r.text)), r.doc_id


def test_licences_held_out_wordings(spark, awkward, nothing, documents):
    model = licence_scan.fit(documents)
    rows = [
        (1, "licensed under the terms of the apache license version 2.0\nfoo bar", "Apache-2.0"), (2, "released under the mit license", "MIT"),
        (3, "This file is licensed under the GNU General Public License version 3 only", "GPL"),
        (4, "Redistribution and use in source and binary forms, with or without any modification, are permitted", "BSD"),
        (5, "He got a license to drive in the general area of the public park.", ""), (6, "rights", ""), (7, "", ""), (8, None, ""),
    ]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = {r.doc_id: r.licences for r in licence_scan.documents(docs, model).collect()}
    assert got == {i: want for i, _, want in rows}
    assert licence_scan.documents(awkward, model).count() == 13
    assert licence_scan.documents(nothing, model).collect() == [] and licence_scan.fit(nothing).threshold <= 0.95
