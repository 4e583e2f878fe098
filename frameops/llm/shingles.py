"""Word shingles and their signatures, for whole batches of texts inside a task."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np

#: A-Z to a-z; other letters keep their case.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
SLICE_BYTES = 1 << 20


@lru_cache
def constants(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit numbers."""
    return np.random.default_rng(seed).integers(0, 2**64, n, dtype=np.uint64) | np.uint64(1)


SPACES = np.zeros(256, dtype=bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
BYTE_CODES = np.where(SPACES, np.uint64(0), constants(256, 3))
BASE, LENGTH_FACTOR = constants(2, 4)
#: Inverse of BASE modulo 2**64.
UNBASE = np.uint64(pow(int(BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_tables = {"up": _powers(BASE, SLICE_BYTES), "down": _powers(UNBASE, SLICE_BYTES)}


def hashed_spans(codes: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of every span of a buffer: a polynomial of its codes, taken from running sums over the buffer."""
    n = len(codes)
    if n > len(_tables["up"]):
        _tables.update(up=_powers(BASE, n), down=_powers(UNBASE, n))
    sums = np.cumsum(codes * _tables["up"][:n])
    before = np.where(first > 0, sums[first - 1], np.uint64(0))
    return (sums[end - 1] - before) * _tables["down"][first] + (end - first).astype(np.uint64) * LENGTH_FACTOR


def _hashed(buffer: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word of a buffer that ends with a space."""
    codes = np.frombuffer(buffer.translate(LOWER), dtype=np.uint8)
    edges = np.flatnonzero(np.diff(SPACES[codes], prepend=True))
    first, end = edges[::2], edges[1::2]
    return hashed_spans(BYTE_CODES[codes], first, end), first


def _pieces(text: bytes) -> Iterator[bytes]:
    """A text in pieces of about ``SLICE_BYTES`` that end between words."""
    start = 0
    while start < len(text):
        end = start + SLICE_BYTES
        while end < len(text) and not SPACES[text[end]]:
            end += 1
        yield text[start:end] + b" "
        start = end


def word_hashes(texts: list[bytes | None]) -> list[np.ndarray]:
    """For every text one 64-bit hash per word; words are runs without space and 0x09-0x0D, A-Z in lower case."""
    out: list[np.ndarray] = []
    for run in sliced(texts):
        if len(run) == 1:
            parts = [_hashed(piece)[0] for piece in _pieces(run[0] or b"")]
            out.append(np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64))
            continue
        hashes, first = _hashed(b" ".join([t or b"" for t in run]) + b" ")
        starts = np.cumsum([len(t or b"") + 1 for t in run[:-1]])
        out += np.split(hashes, np.searchsorted(first, starts))
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def grams(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` words, in order; of the whole sequence if it is shorter; empty without words."""
    n = len(hashes)
    if not n:
        return hashes
    width = min(width, n)
    out = np.zeros(n - width + 1, dtype=np.uint64)
    for i, factor in enumerate(constants(width, 5)):
        out += hashes[i: n - width + 1 + i] * factor
    return _mixed(out)


def shingle_sets(texts: list[bytes | None], width: int) -> list[np.ndarray]:
    """Sorted distinct shingles of every text."""
    return [distinct(grams(h, width)) for h in word_hashes(texts)]


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


def sliced(texts: Iterable[bytes | None]) -> Iterator[list[bytes | None]]:
    """``texts`` in runs of at most ``SLICE_BYTES`` or one text, so that very long texts don't add up."""
    run, held = [], 0
    for text in texts:
        size = len(text or b"") + 1
        if run and held + size > SLICE_BYTES:
            yield run
            run, held = [], 0
        run.append(text)
        held += size
    if run:
        yield run


def min_hashes(sets: list[np.ndarray], coordinates: int, seed: int) -> np.ndarray:
    """A row of ``coordinates`` minima for every set; zeros for an empty one."""
    out = np.zeros((len(sets), coordinates), dtype=np.uint64)
    filled = [i for i, s in enumerate(sets) if len(s)]
    if not filled:
        return out
    values = np.concatenate([sets[i] for i in filled])
    starts = np.cumsum([0, *(len(sets[i]) for i in filled[:-1])])
    pairs = zip(constants(coordinates, seed), constants(coordinates, seed + 1))
    for k, (factor, flip) in enumerate(pairs):
        out[filled, k] = np.minimum.reduceat((values ^ flip) * factor, starts)
    return out


def fingerprint(data: bytes) -> bytes:
    """128 bits that stand for a set."""
    return blake2b(data, digest_size=16).digest()
