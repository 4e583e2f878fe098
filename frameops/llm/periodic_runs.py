"""Runs of periodically repeated words: minimizers of several scales give seeds, which are extended and verified."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction
from functools import partial
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from frameops.llm.shingles import constants

#: A run has at least so many words and so many periods.
MIN_WORDS, MIN_PERIODS = 24, 3
#: Periods up to this are found by comparing the words with themselves, shifted. At least twice MIN_WORDS less two.
DIRECT = 48
#: Words that are searched together; a longer text is searched alone.
TOGETHER = 200_000
BASE, MIX = constants(2, 12)
NEVER = np.uint64(2**64 - 1)

Runs = np.ndarray  # (start, length, period) in rows


def _stretches(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place + 1 of every stretch of true flags."""
    edges = np.flatnonzero(np.diff(flags.view(np.int8), prepend=0, append=0))
    return edges[::2], edges[1::2]


def _primes(n: int) -> list[int]:
    found, d = [], 2
    while d * d <= n:
        if n % d == 0:
            found.append(d)
            while n % d == 0:
                n //= d
        d += 1
    return found + [n] * (n > 1)


def _primitive(words: np.ndarray, start: int, period: int) -> bool:
    """Whether the words of one period are no repetition themselves."""
    block = words[start: start + period]
    return not any(np.array_equal(block[period // f:], block[: -(period // f)]) for f in _primes(period))


def _direct(words: np.ndarray, longest: int) -> Iterator[tuple[int, int, int]]:
    """Runs with a period up to ``DIRECT``."""
    for period in range(1, min(DIRECT, longest // MIN_PERIODS) + 1):
        starts, ends = _stretches(words[period:] == words[:-period])
        long_enough = ends - starts >= max(MIN_WORDS, MIN_PERIODS * period) - period
        for start, end in zip(starts[long_enough].tolist(), ends[long_enough].tolist()):
            if _primitive(words, start, period):
                yield start, end - start + period, period


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest value of every window, by windows of doubling width."""
    done = 1
    while done * 2 <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    return np.minimum(values[: len(values) - (width - done)], values[width - done:]) if width > done else values


def _gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words, from running sums of a polynomial; equal runs have equal hashes."""
    codes = words.astype(np.uint64) * MIX
    codes ^= codes >> np.uint64(29)
    powers = np.full(len(words) + 1, BASE, dtype=np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    unbase = np.full(len(words) + 1, np.uint64(pow(int(BASE), -1, 1 << 64)), dtype=np.uint64)
    unbase[0] = 1
    unbase = np.multiply.accumulate(unbase)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * powers[:-1])])
    hashes = (sums[size:] - sums[:-size]) * unbase[: len(words) - size + 1]
    hashes ^= hashes >> np.uint64(31)
    hashes *= MIX
    return hashes ^ (hashes >> np.uint64(30))


def _minimizers(words: np.ndarray, size: int, window: int, shorter: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Places that hold the leftmost smallest gram of some window, and the hashes there.

    A gram inside a run of at most a third of its size, together with the word before it, is never taken: there all
    grams repeat and every place would be one. What is left of equal grams lies over a third of their size apart.
    """
    hashes = _gram_hashes(words, size)
    bits = np.uint64(len(hashes).bit_length())
    keys = (hashes >> bits << bits) | np.arange(len(hashes), dtype=np.uint64)
    for start, length, period in shorter:
        if MIN_PERIODS * period <= size and length > size:
            keys[start + 1: start + length - size + 1] = NEVER
    best = np.unique(_smallest(keys, window))
    places = (best[best != NEVER] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    return places, hashes[places]


def _seeds(places: np.ndarray, hashes: np.ndarray, low: int, high: int) -> Iterator[tuple[int, int]]:
    """(period, place) of all equal minimizers more than ``low`` and at most ``high`` words apart."""
    order = np.lexsort((places, hashes))
    places, hashes = places[order], hashes[order]
    found = []
    for step in range(1, len(places)):
        lags = places[step:] - places[:-step]
        near = (hashes[step:] == hashes[:-step]) & (lags <= high)
        if not near.any():
            break
        near &= lags > low
        found.append(np.column_stack([lags[near], places[:-step][near]]))
    if found:
        seeds = np.concatenate(found)
        yield from map(tuple, seeds[np.lexsort((seeds[:, 1], seeds[:, 0]))].tolist())


def _matching(left: np.ndarray, right: np.ndarray) -> int:
    """How many words from the first on are equal, looked at in pieces of doubling length."""
    at, step, n = 0, 64, min(len(left), len(right))
    while at < n:
        end = min(at + step, n)
        differ = left[at:end] != right[at:end]
        if (first := int(differ.argmax())) or differ[0]:
            return at + first
        at, step = end, step * 2
    return n


def _extended(words: np.ndarray, seeds: Iterator[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
    """Runs of the periods of ``seeds`` around their places. Seeds come by period and place: none inside the last stretch is new."""
    lag, end = 0, -1
    for period, place in seeds:
        if period != lag:
            lag, end = period, -1
        if place < end:
            continue
        forward = _matching(words[place:], words[place + period:])
        if not forward:
            continue
        back = _matching(words[place - 1:: -1], words[place + period - 1: period - 1: -1]) if place else 0
        end = place + forward
        start, length = place - back, back + forward + period
        if length >= max(MIN_WORDS, MIN_PERIODS * period) and _primitive(words, start, period):
            yield start, length, period


def _searched(words: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """All runs of ``words``, whose parts are at most ``longest`` words and separated by words that occur once.

    A scale covers periods from P to 2P - P/6. Its grams have P/2 words and its windows 3P/2 grams, 2P words in all
    with the word before: some window and its copy a period later both lie inside a run of three periods, so they
    take grams a period apart. Such a window cannot lie whole in a run of a much shorter period, since two
    periods that share their summed length have a common divisor.
    """
    found = list(_direct(words, longest))
    low = DIRECT
    while MIN_PERIODS * (low + 1) <= longest:
        size = low // 2
        high = 2 * low - size // 3
        if len(words) >= 2 * low:
            shorter = [r for r in found if MIN_PERIODS * r[2] <= size]
            found += _extended(words, _seeds(*_minimizers(words, size, 2 * low - size, shorter), low, high))
        low = high
    return found


def find_runs(texts: list[np.ndarray]) -> list[Runs]:
    """Runs (start, length, period) of every text, by start and then period. Texts are arrays of word numbers from 0 on.

    A run is a stretch with smallest period q and at least ``max(MIN_WORDS, MIN_PERIODS * q)`` words that no
    neighbouring word extends. Texts are searched together, longer ones after the shorter ones are done.
    """
    out = [np.zeros((0, 3), dtype=np.int64)] * len(texts)
    order = sorted((i for i, t in enumerate(texts) if len(t) >= MIN_WORDS), key=lambda i: len(texts[i]))
    at = 0
    while at < len(order):
        group, total = [], 0
        while at < len(order) and (not group or total + len(texts[order[at]]) <= TOGETHER):
            group.append(order[at])
            total += len(texts[order[at]]) + 1
            at += 1
        above = max(int(texts[i].max()) for i in group) + 1
        lengths = np.array([len(texts[i]) for i in group])
        starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
        joined = np.empty(total, dtype=np.int64)
        for k, i in enumerate(group):
            joined[starts[k]: starts[k] + lengths[k]] = texts[i]
            joined[starts[k] + lengths[k]] = above + k
        runs = np.array(_searched(joined, int(lengths.max())), dtype=np.int64).reshape(-1, 3)
        runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
        owner = np.searchsorted(starts, runs[:, 0], side="right") - 1
        runs[:, 0] -= starts[owner]
        for k in np.unique(owner):
            out[group[k]] = runs[owner == k]
    return out


def kept_words(n: int, runs: Runs) -> np.ndarray:
    """Numbers of the words that no run holds after its first period."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.flatnonzero(np.cumsum(change[:n]) == 0)


@dataclass
class Text:
    """Words of a text and the runs in it."""

    doc_id: int | None
    words: list[bytes]
    runs: Runs

    def collapsed(self) -> bytes:
        """The words that stay, joined by spaces."""
        if not len(self.runs):
            return b" ".join(self.words)
        return b" ".join([self.words[i] for i in kept_words(len(self.words), self.runs).tolist()])


def repeating(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The stated test repetition: every tenth id, by its checksum, has the words from some place on repeat.

    Texts without an id or without words stay as they are.
    """
    if doc_id is None or not words:
        return words
    h = crc32(str(doc_id).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def _texts(batch: pa.RecordBatch, change: Callable | None) -> Iterator[Text]:
    """Texts of a batch with their runs, taken in groups of about ``TOGETHER`` words."""
    ids, words, size = [], [], 0
    for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
        # of bytes, split() parts at the six white-space characters of ASCII
        own = (text.as_py() or b"").split()
        ids.append(doc_id)
        words.append(change(doc_id, own) if change else own)
        size += len(own)
        if size >= TOGETHER:
            yield from _with_runs(ids, words)
            ids, words, size = [], [], 0
    yield from _with_runs(ids, words)


def _with_runs(ids: list[int | None], words: list[list[bytes]]) -> Iterator[Text]:
    if not ids:
        return
    numbers = pa.array([w for own in words for w in own], pa.large_binary()).dictionary_encode().indices.to_numpy()
    parts = np.split(numbers, np.cumsum([len(own) for own in words])[:-1])
    yield from map(Text, ids, words, find_runs(parts))


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(t.doc_id, *run) for t in _texts(batch, None) for run in t.runs.tolist()]
        columns = list(zip(*rows)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "period"])


def _collapsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(t.doc_id, t.collapsed().decode()) for t in _texts(batch, None)]
        ids, texts = zip(*rows) if rows else ([], [])
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])


def _digested(batches: Iterator[pa.RecordBatch], change: Callable | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for t in _texts(batch, change):
            runs = t.runs.tolist()
            best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
            places = "".join(f"{start},{length},{period}\n" for start, length, period in runs)
            rows.append((
                t.doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
                sha256(places.encode()).hexdigest(), sha256(t.collapsed()).hexdigest()))
        columns = list(zip(*rows)) or [[]] * 8
        kinds = [pa.int64()] * 6 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], DIGEST_NAMES)


DIGEST = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
          "runs_sha256 string, collapsed_sha256 string")
DIGEST_NAMES = [column.split()[0] for column in DIGEST.split(", ")]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per run: ``doc_id``, ``start`` (word number from 0), ``length`` and ``period``, in words.

    A null text has no words. Repeated rows give their runs again; other columns are ignored. A text is
    searched whole in one task, in memory in proportion to it and time in proportion to its length times the
    logarithm of its length. No shuffle.
    """
    return _rows(docs, id_col, text_col).mapInArrow(_listed, "doc_id long, start long, length long, period long")


def collapse(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``text`` without the words that a run holds after its first period, joined by single spaces.

    Every row gives one row; null texts become empty.
    """
    return _rows(docs, id_col, text_col).mapInArrow(_collapsed, "doc_id long, text string")


def digest(docs: DataFrame, change: Callable | None = repeating, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: number of runs, the run of the greatest exponent (nulls without a run), sums of all runs and of what stays.

    ``change`` makes the words that are searched from id and words.
    """
    return _rows(docs, id_col, text_col).mapInArrow(partial(_digested, change=change), DIGEST)
