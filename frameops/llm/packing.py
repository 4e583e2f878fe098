"""Packs tokenised documents into sequences: best fit of vectors of tokens, documents and attention cost."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from frameops.llm.encoder import encoder
from frameops.llm.store import stored

END = 2
#: Pieces that one task packs on average; each such group may leave one sequence that is not full.
GROUP_PIECES = 16_384
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(ids: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of a document's pieces: all of full length but the first."""
    first = ids % capacity or capacity
    return [(0, min(first, ids)), *((s, capacity) for s in range(first, ids, capacity))]


def _pieces(batches: Iterator[pa.RecordBatch], vocabulary: str, capacity: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    encode = encoder(vocabulary).encode
    unique = TaskContext.get().partitionId() << 33
    end = np.array([END], dtype="<u4")
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            rows = []
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text")):
                data = np.append(encode(text.as_py()), end).astype("<u4")
                for piece, (start, length) in enumerate(cut(len(data), capacity)):
                    ids = data[start: start + length]
                    rows.append((doc_id, piece, start, length, zlib.crc32(ids), unique, ids))
                    unique += 1
            columns = list(zip(*rows))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "piece_id"]
            if with_ids:
                arrays.append(pa.array([x.astype(np.int32) for x in columns[6]], pa.list_(pa.int32())))
                names.append("token_ids")
            yield pa.RecordBatch.from_arrays(arrays, names)


def pieces(docs: DataFrame, vocabulary: str, capacity: int = 1024, with_ids: bool = False, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """Documents as token pieces of at most ``capacity``, the end token included; ``with_ids`` adds the ids."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    run = partial(_pieces, vocabulary=vocabulary, capacity=capacity, with_ids=with_ids)
    return rows.mapInArrow(run, PIECES + ", piece_id long" + ", token_ids array<int>" * with_ids)


def best_fit(lengths: np.ndarray, capacity: np.ndarray, weights: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every piece, longest first.

    A bin has three residual capacities: tokens, documents and attention cost (the sum of squared lengths).
    Of the bins that keep within all three, ``residual_norm`` takes the one with the smallest weighted
    norm of what would be left, ``dot_product`` the one whose residuals agree most with the demand.
    """
    n = len(lengths)
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    left = np.zeros((n, 3))
    names = np.zeros(n, dtype=np.int64)
    live = opened = 0
    smallest = lengths.min() if n else 0
    scale = weights / capacity
    for i in order:
        demand = np.array([lengths[i], 1.0, float(lengths[i]) ** 2])
        if (demand > capacity).any():
            raise ValueError("a piece is larger than a sequence may be")
        fits = np.flatnonzero(left[:live, 0] >= demand[0])
        if len(fits):
            fits = fits[(left[fits, 1] >= 1) & (left[fits, 2] >= demand[2])]
        if len(fits):
            if rule == "residual_norm":
                at = fits[np.argmin((((left[fits] - demand) * scale) ** 2).sum(axis=1))]
            else:
                at = fits[np.argmax((left[fits] / capacity * (demand / capacity) * weights).sum(axis=1))]
        else:
            at, live = live, live + 1
            left[at], names[at], opened = capacity, opened, opened + 1
        bins[i], offsets[i] = names[at], capacity[0] - left[at, 0]
        left[at] -= demand
        if left[at, 0] < smallest or left[at, 1] < 1:
            live -= 1
            left[at], names[at] = left[live], names[live]
    return bins, offsets


def _packed(rows: pa.Table, capacity: np.ndarray, weights: np.ndarray, rule: str, groups: int) -> pa.Table:
    table = rows.sort_by("piece_id")
    bins, offsets = best_fit(table.column("length").to_numpy(), capacity, weights, rule)
    group = table.column("group").to_numpy()
    table = table.append_column("sequence_id", pa.array(bins * groups + group, pa.int64()))
    return table.append_column("offset", pa.array(offsets, pa.int64())).drop_columns(["piece_id", "group"])


def pack(cut_pieces: DataFrame, capacity: int = 1024, max_documents: int | None = None, max_cost: float | None = None,
         weights: tuple[float, float, float] = (1.0, 0.05, 0.05), rule: str = "residual_norm",
         group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to stored pieces.

    A full piece is a sequence of its own. The others, one per document at most, are dealt over groups of about
    ``group_pieces`` by a hash of their number, and every group is packed by vector best fit. The number of
    groups grows with the table; a hot source or one id in many rows is dealt like any other. Without
    ``max_documents`` and ``max_cost`` those limits are the largest that a full sequence can reach.
    """
    limits = np.array([capacity, max_documents or capacity, max_cost or float(capacity) ** 2])
    full = cut_pieces.filter(F.col("length") == capacity)
    rest = cut_pieces.filter(F.col("length") < capacity)
    groups = 1 + rest.count() // group_pieces

    def run(rows: pa.Table) -> pa.Table:
        return _packed(rows, limits, np.array(weights), rule, groups)

    schema = f"{PIECES}, sequence_id long, offset long"
    placed = rest.withColumn("group", F.pmod(F.xxhash64("piece_id"), F.lit(groups))).groupBy("group").applyInArrow(
        run, schema)
    alone = full.select("doc_id", "piece", "start", "length", "ids_crc32", (-1 - F.col("piece_id")).alias("sequence_id"),
                        F.lit(0).cast("long").alias("offset"))
    return alone.unionByName(placed)


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 1024, id_col: str = "doc_id",
                   text_col: str = "text", **limits) -> DataFrame:
    """Pieces of every document with ``sequence_id`` and ``offset``; see :func:`pack` for the limits.

    A null or empty text is the end token alone. Every row is a document, also with a repeated or null id;
    other columns are ignored; no documents give no pieces. Long texts are cut into pieces, all
    full but the first; nothing is dropped.
    """
    return pack(stored(pieces(docs, vocabulary, capacity, False, id_col, text_col)), capacity, **limits)
