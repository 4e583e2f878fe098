"""Near-duplicate vectors: robust-pruned flat graphs on overlapping shards, searched greedily and by range."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from frameops.llm.components import components
from frameops.llm.store import stored

SEED = 11
#: Vectors that the shards' centres are chosen from at most; every vector is indexed.
CENTRE_SAMPLE = 20_000
#: Vectors of a shard on average. A shard with more is dealt over blocks, and its vectors search every block.
SHARD = 1_000
#: A vector belongs to this many of the shards with the nearest centres.
OVERLAP = 3
DEGREE = 24
CANDIDATES = 48
#: Robust pruning drops a candidate that a taken one is closer to, by this factor of the distance.
ALPHA = 1.2
BEAM = 24
#: A range search goes on through vectors this far below the threshold.
SLACK = 0.03
QUERIES_AT_ONCE = 256


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def prune(own: np.ndarray, between: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Of every row's candidates, nearest first, at most ``DEGREE`` that no taken one stands for; -1 where none.

    ``own`` has squared distances to the candidates, ``between`` those among them.
    """
    n = len(candidates)
    alive = np.ones(candidates.shape, dtype=bool)
    out = np.full((n, DEGREE), -1, dtype=np.int64)
    rows = np.arange(n)
    for k in range(DEGREE):
        first = np.argmax(alive, axis=1)
        some = alive[rows, first]
        if not some.any():
            break
        out[some, k] = candidates[rows, first][some]
        alive &= ALPHA**2 * between[rows, first] > own
        alive[rows, first] = False
    return out


def build(vectors: np.ndarray) -> np.ndarray:
    """Adjacency of a flat graph: for every vector its pruned neighbours, then vectors that chose it; -1 where none."""
    n = len(vectors)
    c = min(CANDIDATES, n - 1)
    if c < 1:
        return np.full((n, 1), -1, dtype=np.int64)
    kept = []
    for at in range(0, n, QUERIES_AT_ONCE):
        part = vectors[at: at + QUERIES_AT_ONCE]
        dots = part @ vectors.T
        dots[np.arange(len(part)), np.arange(at, at + len(part))] = -2
        best = np.argpartition(-dots, c - 1, axis=1)[:, :c]
        order = np.argsort(-np.take_along_axis(dots, best, 1), axis=1, kind="stable")
        best = np.take_along_axis(best, order, 1)
        near = vectors[best]
        kept.append(prune(2 - 2 * np.take_along_axis(dots, best, 1), 2 - 2 * near @ near.transpose(0, 2, 1), best))
    forward = np.concatenate(kept)
    source, target = np.nonzero(forward >= 0)[0], forward[forward >= 0]
    nearness = np.einsum("ed,ed->e", vectors[source], vectors[target])
    order = np.lexsort((-nearness, target))
    source, target = source[order], target[order]
    place = np.arange(len(target)) - np.searchsorted(target, target)
    fits = place < DEGREE
    back = np.full((n, DEGREE), -1, dtype=np.int64)
    back[target[fits], place[fits]] = source[fits]
    return np.concatenate([forward, back], axis=1)


def _reached(graph: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Which vectors the edges lead to from ``entries``."""
    reached = np.zeros(len(graph), dtype=bool)
    while len(entries):
        reached[entries] = True
        near = graph[entries]
        near = np.unique(near[near >= 0])
        entries = near[~reached[near]]
    return reached


def _medoids(vectors: np.ndarray, members: np.ndarray, root: np.ndarray, least: int = 1) -> np.ndarray:
    """Of every piece, the ``members`` with the same root, of ``least`` vectors or more: the one nearest to their mean."""
    _, piece, sizes = np.unique(root[members], return_inverse=True, return_counts=True)
    sums = np.zeros((len(sizes), vectors.shape[1]))
    np.add.at(sums, piece, vectors[members])
    order = np.lexsort((-np.einsum("ed,ed->e", vectors[members], sums[piece]), piece))
    return members[order[np.searchsorted(piece[order], np.flatnonzero(sizes >= least))]]


def entries_of(vectors: np.ndarray, graph: np.ndarray, threshold: float) -> np.ndarray:
    """Vectors that searches start from: every vector is reached from one of them.

    They are the medoids of the graph's connected pieces, and of the groups within the range of more than ``DEGREE``
    vectors, whose edges may all stay inside; then of the pieces that edges lead out of but not into.
    """
    n = len(vectors)
    source, target = np.repeat(np.arange(n), graph.shape[1]), graph.ravel()
    source, target = source[target >= 0], target[target >= 0]
    tight = np.concatenate([
        np.einsum("ed,ed->e", vectors[source[i: i + 50_000]], vectors[target[i: i + 50_000]]) >= threshold - SLACK
        for i in range(0, len(source), 50_000)]) if len(source) else np.zeros(0, dtype=bool)
    out = np.union1d(_medoids(vectors, np.arange(n), _forest(n, source, target)),
                     _medoids(vectors, np.arange(n), _forest(n, source[tight], target[tight]), DEGREE + 1))
    while not (reached := _reached(graph, out)).all():
        among = ~reached[source] & ~reached[target]
        out = np.union1d(out, _medoids(vectors, np.flatnonzero(~reached), _forest(n, source[among], target[among])))
    return out


def search(queries: np.ndarray, vectors: np.ndarray, graph: np.ndarray, threshold: float, entries: np.ndarray,
           own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, vector) at or above ``threshold - SLACK``, found from ``entries`` and from ``own``.

    First a greedy search with a beam walks from the nearest entries to each query, the whole batch step by step. Then the
    range grows from what it found and from the query itself, where ``own`` is its number and not -1: neighbours of all
    vectors within the range are looked at until none is new.
    """
    n, q = len(vectors), len(queries)
    rows = np.arange(q)
    width = min(BEAM, n)
    dots = queries @ vectors[entries].T
    best = np.argsort(-dots, axis=1, kind="stable")[:, :width]
    some = best.shape[1]
    beam = np.full((q, width), entries[0], dtype=np.int64)
    beam[:, :some] = entries[best]
    scores = np.full((q, width), -2.0)
    scores[:, :some] = np.take_along_axis(dots, best, 1)
    seen = np.zeros((q, n), dtype=bool)
    seen[rows[:, None], beam[:, :some]] = True
    opened = np.zeros((q, width), dtype=bool)
    opened[:, some:] = True
    while not opened.all():
        # every query opens its best closed vector
        at = np.argmax(np.where(opened, -3.0, scores), axis=1)
        active = rows[~opened[rows, at]]
        at = at[active]
        opened[active, at] = True
        near = graph[beam[active, at]]
        valid = near >= 0
        near = np.where(valid, near, 0)
        valid &= ~seen[active[:, None], near]
        who, where = np.nonzero(valid)
        found = near[who, where]
        # a vector may be named twice in a row
        fresh = np.unique(active[who] * n + found)
        a, v = fresh // n, fresh % n
        seen[a, v] = True
        new = np.full((len(active), near.shape[1]), -2.0)
        names = np.zeros_like(near)
        spot = np.searchsorted(active, a)
        place = np.arange(len(a)) - np.searchsorted(spot, spot)
        new[spot, place] = np.einsum("ed,ed->e", queries[a], vectors[v])
        names[spot, place] = v
        joined = np.concatenate([scores[active], new], axis=1)
        best = np.argsort(-joined, axis=1, kind="stable")[:, :width]
        scores[active] = np.take_along_axis(joined, best, 1)
        beam[active] = np.take_along_axis(np.concatenate([beam[active], names], axis=1), best, 1)
        fresh_open = np.concatenate([opened[active], new <= -2.0], axis=1)
        opened[active] = np.take_along_axis(fresh_open, best, 1)
    reached = scores >= threshold - SLACK
    inside = np.zeros((q, n), dtype=bool)
    inside[np.nonzero(reached)[0], beam[reached]] = True
    inside[rows[own >= 0], own[own >= 0]] = True
    looked = inside.copy()
    a, v = np.nonzero(inside)
    while len(a):
        following = np.zeros((q, n), dtype=bool)
        for at in range(0, len(a), 20_000):
            near = graph[v[at: at + 20_000]]
            who = np.repeat(a[at: at + 20_000], near.shape[1])
            near = near.ravel()
            following[who[near >= 0], near[near >= 0]] = True
        following &= ~looked
        looked |= following
        x, y = np.nonzero(following)
        keep = np.concatenate([
            np.einsum("ed,ed->e", queries[x[i: i + 50_000]], vectors[y[i: i + 50_000]]) >= threshold - SLACK
            for i in range(0, len(x), 50_000)]) if len(x) else np.zeros(0, dtype=bool)
        a, v = x[keep], y[keep]
        inside[a, v] = True
    return np.nonzero(inside)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), dtype=np.float64).reshape(len(flat), -1)


def _placed(batches, centres: np.ndarray):
    """The ``OVERLAP`` nearest shards of every vector; the first is its home."""
    for batch in batches:
        x = unit(_matrix(batch.column("embedding"))) if batch.num_rows else np.zeros((0, 1))
        for at in range(0, batch.num_rows, 1000):
            dots = x[at: at + 1000] @ centres.T
            best = np.argsort(-dots, axis=1, kind="stable")[:, :OVERLAP]
            yield pa.RecordBatch.from_arrays([
                batch.column("id").slice(at, 1000), batch.column("copies").slice(at, 1000),
                batch.column("embedding").slice(at, 1000),
                pa.array(list(best.astype(np.int32)), pa.list_(pa.int32()))], ["id", "copies", "embedding", "shards"])


def centres_of(sample: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    """Centres by spherical k-means from a random start; an empty cluster keeps its centre."""
    rng = np.random.default_rng(SEED)
    centres = sample[rng.choice(len(sample), min(count, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        nearest = np.concatenate([np.argmax(sample[i: i + 2000] @ centres.T, axis=1) for i in range(0, len(sample), 2000)])
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 1e-9, sums / np.maximum(norms, 1e-9), centres)
    return centres


def _group(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, unit vectors and which rows are indexed, of one block of a shard."""
    return (rows.column("id").to_numpy(), unit(_matrix(rows.column("embedding"))),
            rows.column("indexed").to_numpy(zero_copy_only=False).astype(bool))


def _graph(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("id")
    ids, vectors, _ = _group(rows)
    near = build(vectors)
    return pa.table({"id": pa.array(ids), "near": pa.array([ids[x[x >= 0]] for x in near], pa.list_(pa.int64()))})


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest number that every number below ``n`` reaches by the pairs."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        if (root == before).all():
            break
    return root


def _found(rows: pa.Table, threshold: float) -> pa.Table:
    """For every vector of a shard that links into one of its blocks: the sum of copies it links with, and a smaller id
    or itself that it is connected to.

    A pair that meets in several shards counts in the first shard that both belong to.
    """
    rows = rows.sort_by("id")
    ids, vectors, indexed = _group(rows)
    copies, shards = rows.column("copies").to_numpy(), np.array(rows.column("shards").to_pylist())
    shard = rows.column("shard")[0].as_py()
    members = np.flatnonzero(indexed)
    number = np.full(len(ids), -1)
    number[members] = np.arange(len(members))
    near = rows.column("near").take(pa.array(members)).to_pylist()
    # edges of the united lists that stay in this block
    width = max(map(len, near), default=0)
    graph = np.full((len(members), max(width, 1)), -1, dtype=np.int64)
    for i, own in enumerate(near):
        at = np.searchsorted(ids, own).clip(max=len(ids) - 1)
        at = number[at[ids[at] == own]] if len(own) else at[:0]
        at = at[at >= 0]
        graph[i, :len(at)] = at
    totals = np.zeros(len(ids), dtype=np.int64)
    entries = entries_of(vectors[members], graph, threshold) if len(members) else members
    from_, to = [], []
    for at in range(0, len(ids) if len(members) else 0, QUERIES_AT_ONCE):
        q, v = search(vectors[at: at + QUERIES_AT_ONCE], vectors[members], graph, threshold, entries, number[at: at + QUERIES_AT_ONCE])
        q, v = q + at, members[v]
        other = q != v
        q, v = q[other], v[other]
        exact = np.concatenate([
            np.einsum("ed,ed->e", vectors[q[i: i + 50_000]], vectors[v[i: i + 50_000]]) >= threshold
            for i in range(0, len(q), 50_000)]) if len(q) else np.zeros(0, dtype=bool)
        from_.append(q[exact])
        to.append(v[exact])
    q, v = np.concatenate([members[:0], *from_]), np.concatenate([members[:0], *to])
    # what one end found, the other has found too
    back = indexed[q]
    code = np.unique(np.concatenate([q * len(ids) + v, v[back] * len(ids) + q[back]]))
    q, v = code // len(ids), code % len(ids)
    root = _forest(len(ids), q, v)
    for at in range(0, len(q), 50_000):
        a, b = q[at: at + 50_000], v[at: at + 50_000]
        both = (shards[a][:, :, None] == shards[b][:, None, :]).any(axis=2)
        first = np.where(both, shards[a], np.iinfo(np.int32).max).min(axis=1) == shard
        np.add.at(totals, a[first], copies[b[first]])
    linked = np.unique(q)
    return pa.table({"id": pa.array(ids[linked]), "links": pa.array(totals[linked]), "low": pa.array(ids[root[linked]])})


def vectors_of(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id`` and ``embedding`` of the rows that can have a cosine: an id, finite components, not all zero."""
    x = F.col(vector_col).cast("array<double>")
    number = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return (
        table.select(F.col(id_col).cast("long").alias("id"), x.alias("embedding"))
        .filter(F.col("id").isNotNull() & F.forall("embedding", number) & F.exists("embedding", lambda c: c != 0))
    )


def near_duplicates(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                    threshold: float = 0.95) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` of every row of ``table``.

    Vectors with a cosine at or above ``threshold``, in double precision, are linked. Equal vectors are one class that
    counts as many links as it has rows. Classes belong to the ``OVERLAP`` shards with the nearest centres; every shard
    builds a robust-pruned graph, the adjacency lists of all shards are united, and every vector is searched for in its
    shards from the medoids of their pieces, then by range, also from itself. Found pairs are verified. The search is approximate: see :func:`audit`.

    Null, zero and non-finite vectors, rows without an id, and vectors of another length than most link with
    nothing: no links, their own id (or null) as component, kept. Rows that repeat an id are vectors of their own.
    Other columns are ignored; an empty table gives an empty result.
    """
    spark = table.sparkSession
    valid = vectors_of(table, id_col, vector_col)
    usual = valid.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dimension = usual["n"] if usual else 0
    valid = valid.filter(F.size("embedding") == dimension)
    classes = stored(valid.groupBy("embedding").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")))
    distinct = classes.count()
    sample = classes.orderBy(F.xxhash64("id", F.lit(SEED)), "id").limit(CENTRE_SAMPLE).select("embedding").collect()
    centres = centres_of(unit(np.array([r[0] for r in sample])), 1 + distinct * OVERLAP // SHARD) if sample else np.zeros((1, 1))
    placed = classes.mapInArrow(
        lambda batches: _placed(batches, centres),
        "id long, copies long, embedding array<double>, shards array<int>",
    ).withColumn("shard", F.explode("shards"))
    placed = stored(placed)
    blocks = placed.groupBy("shard").agg((1 + F.count(F.lit(1)) / (3 * SHARD)).cast("int").alias("blocks"))
    members = placed.join(blocks, "shard").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))

    def graph(rows: pa.Table) -> pa.Table:
        return _graph(rows)

    def found(rows: pa.Table) -> pa.Table:
        return _found(rows, threshold)

    lists = members.select("shard", "own", "id", "embedding", F.lit(True).alias("indexed")).groupBy("shard", "own").applyInArrow(
        graph, "id long, near array<bigint>")
    united = lists.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    visits = members.join(united, "id").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "shard", "block", "id", "copies", "embedding", "shards", "near", (F.col("own") == F.col("block")).alias("indexed"))
    links = stored(visits.groupBy("shard", "block").applyInArrow(found, "id long, links long, low long"))
    counts = links.groupBy("id").agg(F.sum("links").alias("links"))
    reached = components(links.select(F.col("id").alias("a"), F.col("low").alias("b")))
    result = classes.join(counts, "id", "left").join(reached, "id", "left").select(
        "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "id").alias("component"))
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    return (
        rows.join(result, "embedding", "left")
        .select(
            F.col("id").alias("vec_id"),
            F.when(F.col("id").isNotNull(), F.coalesce("n_links", F.lit(0).cast("long"))).otherwise(F.lit(0)).alias("n_links"),
            F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )


def audit(table: DataFrame, result: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
          threshold: float = 0.95, queries: int = 200) -> float:
    """Share of the true links of ``queries`` vectors, picked by a hash of their id, that ``result`` has.

    The sample is compared with all vectors by brute force. Without any true link the share is 1.
    """
    valid = vectors_of(table, id_col, vector_col)
    sample = valid.orderBy(F.xxhash64("id", F.lit(SEED + 1)), "id").limit(queries).collect()
    if not sample:
        return 1.0
    asked = unit(np.array([r["embedding"] for r in sample]))

    def count(batches):
        for batch in batches:
            if batch.num_rows:
                near = (unit(_matrix(batch.column("embedding"))) @ asked.T >= threshold).sum(axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(asked))), pa.array(near)], ["query", "n"])

    true = valid.mapInArrow(count, "query long, n long").groupBy("query").agg(F.sum("n").alias("n")).collect()
    wanted = {sample[r["query"]]["id"]: r["n"] - 1 for r in true}
    got = result.filter(F.col("vec_id").isin(list(wanted))).collect()
    total = sum(wanted.values())
    return sum(min(r["n_links"], wanted[r["vec_id"]]) for r in got) / total if total else 1.0
