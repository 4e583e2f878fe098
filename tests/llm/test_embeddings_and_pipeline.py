from collections import Counter

import numpy as np

import corpus_pipeline
from frameops.llm import decontaminate, embedding_dedup as E, toxicity
from test_minhash_dedup import plain as plain_groups
from test_spans import PII, plain as plain_spans
from test_tokens_and_packing import checked


def plain(ids, vectors, threshold=0.95):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = unit @ unit.T >= threshold
    np.fill_diagonal(near, False)
    a, b = np.nonzero(near)
    root = E._forest(len(ids), a, b)
    low = [min(ids[k] for k in np.flatnonzero(root == r)) for r in root]
    return {i: (int(n), c) for i, n, c in zip(ids, near.sum(1), low)}


def clustered(seed, clusters=12, each=40, dim=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim))
    return np.concatenate([centres[k] + 0.22 * rng.normal(size=(each, dim)) for k in range(clusters)] + [rng.normal(size=(200, dim))])


def test_links_of_clusters(spark, monkeypatch):
    vectors = clustered(1)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [(1000 + i, rows[3][1]) for i in range(30)]
    want = plain([i for i, _ in rows], np.array([v for _, v in rows]))
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for shard in (1000, 100):
        monkeypatch.setattr(E, "SHARD", shard)
        result = E.near_duplicates(table).cache()
        got = {r.vec_id: (r.n_links, r.component_id) for r in result.collect()}
        assert sum(n for n, _ in got.values()) >= 0.97 * sum(n for n, _ in want.values())
        assert all(got[i][0] <= want[i][0] for i in want)
        assert sum(got[i][1] == want[i][1] for i in want) >= 0.97 * len(want)
        assert E.audit(table, result) >= 0.95


def test_groups_that_no_edge_leaves(spark):
    rng = np.random.default_rng(5)
    centres = E.unit(rng.normal(size=(20, 64)))
    vectors = E.unit(np.repeat(centres, 100, axis=0) + 0.02 * rng.normal(size=(2000, 64)))
    want = plain(list(range(2000)), vectors)
    table = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in E.near_duplicates(table).collect()}
    assert sum(n for n, _ in got.values()) >= 0.99 * sum(n for n, _ in want.values())
    assert sum(got[i][1] == want[i][1] for i in want) >= 0.99 * len(want)
    assert all(got[i][0] <= want[i][0] for i in want)
    # vectors of other blocks have no place in the graph
    graph = E.build(vectors[::2])
    entries = E.entries_of(vectors[::2], graph, 0.95)
    assert E._reached(graph, entries).all()
    q, v = E.search(vectors[1::2], vectors[::2], graph, 0.95, entries, np.full(1000, -1))
    found = np.zeros((1000, 1000), dtype=bool)
    found[q, v] = True
    true = vectors[1::2] @ vectors[::2].T >= 0.95
    assert (found & true).sum() >= 0.99 * true.sum()


def test_given_vectors(table):
    rows = table("embeddings").collect()
    want = plain([r.vec_id for r in rows], np.array([r.embedding for r in rows], dtype=float))
    got = {r.vec_id: (r.n_links, r.component_id) for r in E.near_duplicates(table("embeddings")).collect()}
    assert got == want


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 1.0]),
            (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (10, [1.0, None]), (11, [0.0, -1.0]), (11, [0.0, -1.0])]
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, id int, shard int")
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in E.near_duplicates(table).collect())
    want = [(1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (11, 1, 11, True), (11, 1, 11, True), (None, 0, None, True)]
    assert got == Counter(want + [(i, 0, i, True) for i in (4, 5, 6, 7, 8, 9, 10)])
    assert E.near_duplicates(table.filter("vec_id > 99")).collect() == []


def test_pipeline_against_plain_versions(spark, documents, document_rows, table):
    sf_dir = "/root/testdata/sf0.001"
    steps = [documents]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        steps.append(stage(spark, steps[-1], sf_dir).cache())
        assert steps[-1].columns == documents.columns, name
    model = toxicity.fit(documents, table("labels"))
    rejected = {r.doc_id for r in toxicity.score(documents, model).collect() if r.predicted}
    rows = [(i, t) for i, t in document_rows if i not in rejected]
    assert {r.doc_id for r in steps[1].collect()} == {i for i, _ in rows}
    kept = {i for i, _, _, k in plain_groups(rows, 4, 5) if k}
    rows = [(i, t) for i, t in rows if i in kept]
    assert {r.doc_id for r in steps[2].collect()} == kept
    index = next(decontaminate.indexes(table("benchmark"), "item_id", "text", 1000))
    from frameops.llm import shingles as S
    rows = [(i, t) for i, t in rows if not index.leaks(S.word_hashes([t.encode()])[0])]
    clean = steps[4].collect()
    assert {r.doc_id for r in clean} == {i for i, _ in rows}
    before = dict(rows)
    for r in clean:
        found = plain_spans(before[r.doc_id], PII, False)[2]
        assert r.n_chars == len(r.text) and (bool(found) <= (r.text != before[r.doc_id]))
        assert not plain_spans(r.text, PII, False)[2]
    packed = corpus_pipeline.run(spark, sf_dir).collect()
    checked(packed, [(r.doc_id, r.text) for r in clean])


def test_stages_bear_awkward_rows(spark, awkward, nothing):
    for docs in (awkward, nothing):
        current = docs.withColumn("n_chars", docs.n)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            following = stage(spark, current, "/root/testdata/sf0.001").cache()
            assert following.columns == current.columns, name
            current = following
        assert corpus_pipeline.STAGES[-1][1](spark, current, "/root/testdata/sf0.001").count() >= current.count()
