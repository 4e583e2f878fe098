"""Near-duplicate documents from an inverted join of signature coordinates, confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import partial
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from frameops.llm import shingles as S
from frameops.llm.components import components
from frameops.llm.sieve import left_out, sieved
from frameops.llm.store import stored

WIDTH = 5
COORDINATES = 16
SEED = 20
#: Chance to miss one link of exactly the threshold's similarity.
MISS = 1e-5
#: Shingles of one block of a bucket: a task holds two blocks at most.
BLOCK_SHINGLES = 1 << 18


def match_threshold(similarity: Fraction, coordinates: int = COORDINATES, miss: float = MISS) -> int:
    """Most collisions that can be asked for if a pair of this similarity shall be missed with chance ``miss``."""
    p, chance = float(similarity), 0.0
    for matches in range(coordinates + 1):
        chance += comb(coordinates, matches) * p**matches * (1 - p) ** (coordinates - matches)
        if chance > miss:
            return max(matches, 1)
    return coordinates


def _signatures(batches: Iterator[pa.RecordBatch], coordinates: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            sets = S.shingle_sets(part.column("text").to_pylist(), WIDTH)
            signatures = S.min_hashes(sets, coordinates, SEED).view(np.int64)
            yield pa.RecordBatch.from_arrays([
                part.column("id"),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([S.fingerprint(s.tobytes()) for s in sets], pa.binary()),
                pa.array(list(signatures), pa.list_(pa.int64())),
            ], ["id", "n_shingles", "set_key", "signature"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            sets = S.shingle_sets(part.column("text").to_pylist(), WIDTH)
            yield pa.RecordBatch.from_arrays([
                part.column("id"),
                pa.array([S.fingerprint(s.tobytes()) for s in sets], pa.binary()),
                pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
            ], ["id", "set_key", "shingles"])


class _Group:
    """The documents of one block or pair of blocks of a bucket."""

    def __init__(self, rows: list[tuple]):
        rows = sorted(rows, key=lambda r: len(r[4]))
        self.ids = [r[0] for r in rows]
        self.side = np.array([r[1] for r in rows])
        self.root = np.array([r[2] for r in rows])
        self.signatures = np.stack([r[3] for r in rows])
        self.sets = [r[4] for r in rows]

    def links(self, matches: int, over: int, under: int) -> Iterator[tuple[int, int]]:
        """Links that join what is not joined yet; pairs that are connected already need no look."""
        sizes = np.array([len(s) for s in self.sets])
        all_sides = len(set(self.side.tolist())) == 1
        local = starts = mark = None
        for i in range(len(self.ids) - 1):
            high = np.searchsorted(sizes * over, sizes[i] * under, side="right")
            if high <= i + 1:
                continue
            near = (self.signatures[i + 1:high] == self.signatures[i]).sum(axis=1) >= matches
            near &= self.root[i + 1:high] != self.root[i]
            if not all_sides:
                near &= self.side[i + 1:high] != self.side[i]
            found = np.flatnonzero(near) + i + 1
            if not len(found):
                continue
            if local is None:
                values, local = np.unique(np.concatenate(self.sets), return_inverse=True)
                starts = np.concatenate([[0], np.cumsum(sizes)])
                mark = np.zeros(len(values), dtype=bool)
            mark[local[starts[i]:starts[i + 1]]] = True
            for j in found:
                if self.root[j] == self.root[i]:
                    continue
                common = int(mark[local[starts[j]:starts[j + 1]]].sum())
                if under * common >= over * (sizes[i] + sizes[j] - common):
                    self.root[self.root == self.root[j]] = self.root[i]
                    yield self.ids[i], self.ids[j]
            mark[local[starts[i]:starts[i + 1]]] = False


def _linked(batches: Iterator[pa.RecordBatch], matches: int, over: int, under: int) -> Iterator[pa.RecordBatch]:
    """Links of every group; rows come sorted by group."""
    def flush(rows: list[tuple]) -> pa.RecordBatch:
        found = list(_Group(rows).links(matches, over, under)) if len(rows) > 1 else []
        return pa.RecordBatch.from_arrays(
            [pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    key, held = None, []
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("coordinate", "value", "low", "high"))))
        side, root, ids = (batch.column(c).to_pylist() for c in ("block", "component", "id"))
        signatures, sets = (batch.column(c) for c in ("signature", "shingles"))
        for i, this in enumerate(keys):
            if this != key:
                if held:
                    yield flush(held)
                key, held = this, []
            # copied, so that the batch can go
            held.append((ids[i], side[i], root[i], np.array(signatures[i].values), np.array(sets[i].values)))
    if held:
        yield flush(held)


GROUP = ["coordinate", "value", "low", "high"]


def _links(members: DataFrame, matches: int, similarity: Fraction) -> DataFrame:
    """Links in groups of members, each group in one task."""
    run = partial(_linked, matches=matches, over=similarity.numerator, under=similarity.denominator)
    return (
        members.select(*GROUP, "block", "component", "id", "signature", "shingles")
        .repartition(*GROUP).sortWithinPartitions(*GROUP)
        .mapInArrow(run, "a long, b long")
    )


def buckets(classes: DataFrame, matches: int) -> DataFrame:
    """Postings ``id, coordinate, value`` that can show a pair of ``matches`` collisions.

    Coordinates are ordered by how many documents share their value. Two documents with so many
    collisions share one of the first ``COORDINATES - matches + 1``, the prefix. A value
    that no other document has shows no pair but counts as part of the prefix.
    """
    postings = classes.select("id", F.posexplode("signature").alias("coordinate", "value"))
    frequent = postings.groupBy("coordinate", "value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = postings.join(frequent, ["coordinate", "value"]).groupBy("id").agg(
        F.sort_array(F.collect_list(F.struct("n", "coordinate", "value"))).alias("shared"))
    open_places = F.size("shared") - (matches - 1)
    return shared.filter(open_places > 0).select(
        "id", F.explode(F.slice("shared", F.lit(1), open_places)).alias("p")
    ).select("id", "p.coordinate", "p.value")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    similarity: Fraction = Fraction(17, 20)) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` of every row of ``docs``.

    Documents with intersection / union of their distinct five-word shingles at or above ``similarity`` are
    linked; ``component_id`` is the smallest id reachable by links. Documents with equal sets are one class,
    which its smallest id stands for. Classes are posted under their signature's coordinates, met
    in the buckets of their prefix, kept as pairs with enough collisions and confirmed on full sets.

    Null or empty texts have no shingles and stand alone. Rows without an id are linked with nothing:
    component null, kept. Rows that share an id are one document as far as links go. Other columns are
    ignored, an empty table gives an empty result.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    matches = match_threshold(similarity)
    signed = stored(texts.mapInArrow(
        partial(_signatures, coordinates=COORDINATES),
        "id long, n_shingles long, set_key binary, signature array<bigint>"))
    usable = signed.filter("n_shingles > 0 and id is not null")
    classes = usable.groupBy("set_key").agg(
        F.min("id").alias("id"), F.first("signature").alias("signature"), F.first("n_shingles").alias("n_shingles"))
    classes = stored(classes)
    posted = stored(buckets(classes, matches))
    wanted = posted.select("id").distinct()
    sets = sieved(texts, wanted, "id").mapInArrow(_sets, "id long, set_key binary, shingles array<bigint>")
    described = stored(
        sets.join(classes, ["id", "set_key"]).dropDuplicates(["id", "set_key"])
        .select("id", "n_shingles", "signature", "shingles"))

    # a bucket is dealt over blocks of bounded size; first each block looks at itself, with the bucket's smallest id
    sizes = posted.join(classes.select("id", "n_shingles"), "id")
    whole = sizes.groupBy("coordinate", "value").agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("pivot"),
        F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES).cast("int").alias("blocks"),
        F.sum(F.xxhash64("id") % (1 << 40)).alias("members"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("folded"),
    ).filter("n > 1")
    # of buckets with the same members one is enough
    whole = whole.groupBy("n", "pivot", "blocks", "members", "folded").agg(
        F.min(F.struct("coordinate", "value")).alias("bucket")).select("bucket.*", "n", "pivot", "blocks")
    placed = posted.join(whole, ["coordinate", "value"]).withColumn(
        "block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    everywhere = F.when(F.col("id") == F.col("pivot"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(
        F.array("block"))
    alone = placed.withColumn("low", F.explode(everywhere)).withColumns(
        {"high": F.col("low"), "block": F.lit(0), "component": F.col("id")})
    first = stored(_links(alone.join(described, "id"), matches, similarity))
    reached = stored(components(first))

    # then blocks of one bucket look at each other, unless all their members are connected by now
    several = placed.filter("blocks > 1").join(reached, "id", "left").withColumn(
        "component", F.coalesce("component", "id"))
    open_buckets = several.groupBy("coordinate", "value").agg(
        F.min("component").alias("least"), F.max("component").alias("most")).filter("least < most")
    pairs = several.join(open_buckets.select("coordinate", "value"), ["coordinate", "value"]).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).filter("other <> block").withColumns(
        {"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    second = stored(_links(pairs.join(described, "id"), matches, similarity))
    if not second.isEmpty():
        reached = components(first.union(second))

    groups = classes.join(reached, "id", "left").select("set_key", F.coalesce("component", "id").alias("component"))
    return (
        signed.join(groups.filter("component is not null"), "set_key", "left")
        .select(F.col("id").alias("doc_id"), "n_shingles",
                F.when(F.col("id").isNotNull() & (F.col("n_shingles") > 0), F.col("component")).otherwise(F.col("id"))
                .alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                similarity: Fraction = Fraction(4, 5)) -> DataFrame:
    """The rows of ``docs``, with all their columns, without those that are near-duplicates of a kept one.

    Of rows that share an id one stays if the id is kept. Rows without an id stay.
    """
    found = stored(near_duplicates(docs, id_col, text_col, similarity).filter("doc_id is not null"))
    gone = found.filter(~F.col("kept")).select(F.col("doc_id").alias(id_col))
    repeated = found.groupBy(F.col("doc_id").alias(id_col)).agg(
        F.count(F.lit(1)).alias("n"), F.bool_and("kept").alias("kept")).filter("n > 1")
    if repeated.isEmpty():
        return left_out(docs, gone, id_col)
    again = sieved(docs, repeated.filter("kept"), id_col).dropDuplicates([id_col])
    return left_out(docs, gone.union(repeated.select(id_col)), id_col).union(again)
