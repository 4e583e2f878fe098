"""Target-distribution importance resampling over words from a regular-expression pre-tokenizer."""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator
from functools import lru_cache, partial
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from tokenizers import Regex
from tokenizers.pre_tokenizers import PreTokenizer, Split

from frameops.llm.store import dropped, stored

#: Digits, small ASCII letters and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
#: Features have one to so many words.
LONGEST = 1
SEED = 2024
#: Documents with fewer words are not drawn; so many of a hundred others are.
MIN_WORDS, PERCENT = 20, 10
#: Buckets of features remembered by a Python worker.
REMEMBERED = 300_000
ROWS = 500

Offsets = list[tuple[int, int]]


@lru_cache(1)
def splitter() -> PreTokenizer:
    return Split(Regex(WORD), behavior="removed", invert=True)


def words(text: bytes | None) -> tuple[str, Offsets]:
    """The text with A-Z lowered, and where its words begin and end."""
    lowered = (text or b"").lower().decode("utf-8", errors="replace")
    return lowered, [place for _, place in splitter().pre_tokenize_str(lowered)]


def windows(lowered: str, places: Offsets, longest: int) -> Iterator[str]:
    """All runs of one to ``longest`` consecutive words, joined by single spaces."""
    own = [lowered[start:end] for start, end in places]
    yield from own
    for size in range(2, longest + 1):
        yield from map(" ".join, zip(*(own[i:] for i in range(size))))


class Buckets(dict):
    """The bucket of every feature seen: its checksum modulo the number of buckets."""

    def __init__(self, n: int):
        super().__init__()
        self.n = n

    def __missing__(self, feature: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        bucket = crc32(feature.encode()) % self.n
        if len(feature) < 40:
            self[feature] = bucket
        return bucket


def _featured(batches: Iterator[pa.RecordBatch], longest: int, n: int) -> Iterator[pa.RecordBatch]:
    bucket = Buckets(n).__getitem__
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            flat, ends, sizes = array("i"), [0], []
            for text in part.column("text"):
                lowered, places = words(text.as_py())
                flat.extend(map(bucket, windows(lowered, places, longest)))
                ends.append(len(flat))
                sizes.append(len(places))
            buckets = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, dtype=np.int32)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), buckets], ["doc_id", "n_words", "buckets"])


def features(docs: DataFrame, longest: int = LONGEST, n: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_words`` and ``buckets`` (one of every feature) of every row of ``docs``.

    Null and empty texts, and those without words, have none. Repeated rows give theirs again; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(partial(_featured, longest=longest, n=n), "doc_id long, n_words long, buckets array<int>")


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All buckets of a batch, and where those of each row begin and end."""
    column = batch.column("buckets")
    ends = column.offsets.to_numpy()
    return column.values.to_numpy(), ends


def _counted(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(n, dtype=np.int64)
    for batch in batches:
        buckets, ends = _flat(batch)
        counts += np.bincount(buckets[ends[0]: ends[-1]], minlength=n)
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["bucket", "n"])


def histogram(featured: DataFrame, n: int = BUCKETS) -> np.ndarray:
    """How many features of all rows fall into every bucket. Tasks send their sums, at most one per bucket."""
    rows = featured.select("buckets").mapInArrow(partial(_counted, n=n), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros(n, dtype=np.int64)
    for row in rows.collect():
        counts[row["bucket"]] = row["n"]
    return counts


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the smoothed log-ratio of target to raw, per bucket."""
    n, raw_total, target_total = len(raw), int(raw.sum()), int(target.sum())
    return np.array([
        math.floor(1000 * math.log((t + 1.0) * (raw_total + n) / ((s + 1.0) * (target_total + n))))
        for s, t in zip(raw.tolist(), target.tolist())], dtype=np.int64)


def _weighed(batches: Iterator[pa.RecordBatch], table: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buckets, ends = _flat(batch)
        sums = np.concatenate([[0], np.cumsum(table[buckets])])
        totals, sizes = sums[ends[1:]] - sums[ends[:-1]], np.diff(ends)
        weights = np.where(sizes > 0, totals // np.maximum(sizes, 1), 0)
        numbers = [pa.array(sizes, pa.int64()), batch.column("n_words"), pa.array(weights, pa.int64())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *numbers], ["doc_id", "n_features", "n_words", "weight"])


def weigh(featured: DataFrame, table: np.ndarray) -> DataFrame:
    """Per row: ``doc_id``, ``n_features``, ``n_words`` and ``weight``, the floored mean gain of its features, 0 without any. No shuffle."""
    return featured.mapInArrow(partial(_weighed, table=table), "doc_id long, n_features long, n_words long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandths of Gumbel noise from a hash of the id; a missing id counts as an empty one."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def _least_drawn(eligible: DataFrame, percent: int) -> tuple[int, int | None]:
    """How many are drawn and the smallest score among them. Scores are whole thousandths within some tens of thousands."""
    counts = eligible.groupBy("score").count().orderBy(F.desc("score")).collect()
    wanted = left = percent * sum(c["count"] for c in counts) // 100
    for c in counts:
        left -= c["count"]
        if left <= 0:
            return wanted, c["score"]
    return wanted, None


def draw(weighed: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """Adds ``score`` (weight plus noise) and ``rank``: 1, 2, 3 ... for the drawn share of rows with ``min_words``, null for others.

    The highest scores are drawn, ties to the smaller id, rows without an id last; rows equal in both are ranked one after
    the other. The least score drawn comes from counts per score; only rows that reach it are sorted, by ranges, so
    no task holds more than a range. A row's rank is its place in the range plus the sizes of the ranges before.
    """
    scored = stored(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    wanted, least = _least_drawn(scored.filter(F.col("n_words") >= min_words), percent)
    no_rank = F.lit(None).cast("long").alias("rank")
    if not wanted:
        return scored.select("*", no_rank)
    reaches = (F.col("n_words") >= min_words) & (F.col("score") >= least)
    # the row number parts equal rows, should they be many
    ordered = scored.filter(reaches).withColumn("row", F.monotonically_increasing_id()).orderBy(
        F.desc("score"), F.asc_nulls_last("doc_id"), "n_features", "weight", "row")
    placed = stored(ordered.withColumn("place", F.monotonically_increasing_id()))
    part, within = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    before, sizes = 0, {}
    for r in placed.groupBy(part.alias("part")).count().orderBy("part").collect():
        sizes[r["part"]] = before
        before += r["count"]
    starts = scored.sparkSession.createDataFrame(list(sizes.items()), "part long, before long")
    ranked = placed.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("rank", within + F.col("before") + 1)
    drawn = ranked.select(*scored.columns, F.when(F.col("rank") <= wanted, F.col("rank")).alias("rank"))
    return drawn.unionByName(scored.filter(~reaches).select("*", no_rank))


def resample(docs: DataFrame, target: DataFrame, longest: int = LONGEST, n: int = BUCKETS, percent: int = PERCENT) -> DataFrame:
    """``doc_id``, ``n_features``, ``weight``, ``score`` and ``rank`` of every row of ``docs`` against all texts of ``target``.

    Texts are split once: their buckets are stored, counted, and weighed. Empty tables count as no features.
    """
    featured = stored(features(docs, longest, n))
    wanted = features(target.select("text", F.lit(None).alias("doc_id")), longest, n)
    table = gains(histogram(featured, n), histogram(wanted, n))
    drawn = draw(weigh(featured, table), percent).select("doc_id", "n_features", "weight", "score", "rank")
    dropped(featured)
    return drawn


#: The same in SQL, with the checksum worked out byte by byte for every distinct word.
SQL = r"""
WITH found AS (
 SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
 FROM documents),
wanted AS (
 SELECT unnest(regexp_extract_all(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
 FROM benchmark),
raw AS (SELECT row_id, unnest(words) AS word FROM found),
checks AS (
 SELECT list(list_reduce(list_concat([i], range(8)), lambda c, step: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t
 FROM range(256) r(i)),
spelt AS (
 SELECT word, hex(encode(word)) AS digits FROM (SELECT word FROM raw UNION SELECT word FROM wanted)),
buckets AS (
 SELECT word, xor(list_reduce(list_concat([4294967295], list_transform(range(length(digits) // 2),
   lambda i: ('0x' || substr(digits, 2 * i + 1, 2))::BIGINT)),
  lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) % 10000 AS bucket
 FROM spelt, checks),
s AS (SELECT bucket, count(*) AS n FROM raw JOIN buckets USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM wanted JOIN buckets USING (word) GROUP BY bucket),
gains AS (
 SELECT b.bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM raw) + 10000)::DOUBLE
   / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM wanted) + 10000)::DOUBLE))) AS BIGINT) AS gain
 FROM (SELECT DISTINCT bucket FROM buckets) b LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
weights AS (
 SELECT row_id, CAST(floor(sum(gain)::DOUBLE / count(*)) AS BIGINT) AS weight
 FROM raw JOIN buckets USING (word) JOIN gains USING (bucket) GROUP BY row_id),
scored AS (
 SELECT doc_id, CAST(len(words) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT
   + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
 FROM found LEFT JOIN weights USING (row_id)),
ranked AS (
 SELECT *, n_features >= 20 AS able, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place FROM scored)
SELECT doc_id, n_features, weight, score,
 CASE WHEN able AND place <= (SELECT 10 * count(*) // 100 FROM scored WHERE n_features >= 20) THEN place END AS rank FROM ranked
"""
