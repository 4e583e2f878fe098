"""Quality by importance resampling: hashed n-gram models of target and raw text, drawn by Gumbel top-k."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from frameops.llm import shingles as S
from frameops.llm.sieve import told
from frameops.llm.store import stored

#: Buckets of hashed words and word pairs.
BUCKETS = 1 << 16
SMOOTHING = 0.5
SEED = 29
#: Sharpness: how many n-grams' worth of a document's mean log-ratio stand against the Gumbel noise.
SHARPNESS = 100.0
#: Cells per round of the search for the k-th largest key.
CELLS = 4096


def ngrams(hashes: np.ndarray) -> np.ndarray:
    """Buckets of a text's words and word pairs."""
    pairs = S.grams(hashes, 2) if len(hashes) > 1 else hashes[:0]
    return (np.concatenate([S.grams(hashes, 1), pairs]) % np.uint64(BUCKETS)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            for hashes, good in zip(S.word_hashes(part.column("text").to_pylist()), part.column("good").to_pylist()):
                buckets, n = np.unique(ngrams(hashes), return_counts=True)
                raw[buckets] += n
                if good:
                    target[buckets] += n
    used = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(raw[used]), pa.array(target[used])], ["bucket", "raw", "target"])


def _smoothed(counts: np.ndarray) -> np.ndarray:
    return np.log((counts + SMOOTHING) / (counts.sum() + SMOOTHING * BUCKETS))


def models(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed log-probabilities of all buckets over all of ``texts`` and over those that are ``good``, from one pass.

    Tasks send their sums, at most two per bucket.
    """
    rows = texts.mapInArrow(_counted, "bucket long, raw long, target long").groupBy("bucket").agg(
        F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    counts = np.zeros((2, BUCKETS))
    for r in rows:
        counts[:, r["bucket"]] = r["raw"], r["target"]
    return _smoothed(counts[0]), _smoothed(counts[1])


def model(texts: DataFrame) -> np.ndarray:
    """Smoothed log-probabilities of all buckets over all of ``texts``."""
    return models(texts.select("text", F.lit(False).alias("good")))[0]


@dataclass
class Ratio:
    """Log-ratio of every bucket, target to raw, and the share of good documents among those with a label."""

    weights: np.ndarray
    share: float


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Ratio:
    """Target: all documents labelled 1; raw: all documents.

    The share of good documents is that of all labels. Without documents labelled 1 all weights are 0, the share 1.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    judged = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(
        F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).alias("label"))
    sizes = {r["label"]: r["count"] for r in judged.groupBy("label").count().collect()}
    if not sizes.get(1):
        return Ratio(np.zeros(BUCKETS), 1.0)
    raw, target = models(told(texts, stored(judged.filter("label = 1").select("id")), "id", "good").select("text", "good"))
    return Ratio(target - raw, sizes[1] / sum(sizes.values()))


def _weighed(batches: Iterator[pa.RecordBatch], weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            found = [ngrams(h) for h in S.word_hashes(part.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([
                part.column("id"), part.column("noise"),
                pa.array([float(weights[x].sum()) for x in found], pa.float64()),
                pa.array([len(x) for x in found], pa.int64())], ["id", "noise", "log_ratio", "n_grams"])


def kth_largest(keys: DataFrame, k: int) -> float:
    """The k-th largest of column ``key``, exactly, by counting ever smaller cells; only cell counts come to the driver."""
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    while low < high:
        width = (high - low) / CELLS
        cell = F.least(F.floor((F.col("key") - low) / width), F.lit(CELLS - 1)) if width > 0 else F.lit(0)
        cells = keys.filter(F.col("key").between(low, high)).groupBy(cell.alias("cell")).agg(
            F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).orderBy(F.desc("cell")).collect()
        for c in cells:
            if c["n"] >= k:
                break
            k -= c["n"]
        if (c["low"], c["high"]) == (low, high):
            # no finer cells are possible: few distinct values are left
            values = keys.filter(F.col("key").between(low, high)).groupBy("key").count().orderBy(F.desc("key")).collect()
            for v in values:
                k -= v["count"]
                if k <= 0:
                    return v["key"]
        low, high = c["low"], c["high"]
    return low


def resample(docs: DataFrame, ratio: Ratio, id_col: str = "doc_id", text_col: str = "text", share: float | None = None,
             sharpness: float = SHARPNESS) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_grams``, ``log_ratio`` (mean per n-gram), ``key`` and ``kept``.

    ``key`` is ``sharpness`` times the mean log-ratio plus Gumbel noise from a hash of id and text: the ``share`` of all
    documents with the largest keys is a draw without replacement by importance. The share of good labels is the default.
    All documents tied with the last one drawn are kept. Null and empty texts have no n-grams and a log-ratio of 0, and
    are not kept. Repeated rows have equal keys; other columns are ignored; an empty table gives an empty result.
    """
    uniform = (F.pmod(F.xxhash64(id_col, text_col, F.lit(SEED)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"),
                       (-F.log(-F.log(uniform))).alias("noise"))
    scored = rows.mapInArrow(partial(_weighed, weights=ratio.weights), "id long, noise double, log_ratio double, n_grams long")
    mean = F.when(F.col("n_grams") > 0, F.col("log_ratio") / F.col("n_grams")).otherwise(0.0)
    keyed = stored(scored.select(F.col("id").alias("doc_id"), "n_grams", mean.alias("log_ratio"), (mean * sharpness + F.col("noise")).alias("key")))
    real = keyed.filter("n_grams > 0")
    wanted = round(real.count() * (ratio.share if share is None else share))
    least = kth_largest(real, wanted) if wanted else float("inf")
    return keyed.withColumn("kept", (F.col("n_grams") > 0) & (F.col("key") >= least))
