"""Finds test items in training passages: a BM25 index of the items, searched with block-max WAND."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from frameops.llm import shingles as S

#: Words of a term of the index, and of a shingle of the check that follows.
TERM = 3
WIDTH = 5
K1, B = 1.2, 0.75
BLOCK = 32
#: Share of an item's own score that a passage has to reach.
RETRIEVE = 0.5
#: Share of an item, or of its question alone, that a passage has to hold.
OVERLAP = 0.8
#: The same of a question whose answer is there too.
WEAK = 0.6
#: Least words of a question that stands for its item without the answer.
QUESTION = 8
#: Least words of a passage; passages overlap by half.
PASSAGE = 128
#: Items of one index on average; more items are searched for block by block.
INDEX_ITEMS = 20_000
SENTENCE = re.compile(rb"(?<=[.!?])\s+|\n+")
PREFILTER = 1 << 18


@dataclass
class Postings:
    """Items that hold a term, in order, with their impacts and the largest impact of every block."""

    items: list[int] = field(default_factory=list)
    impacts: list[float] = field(default_factory=list)
    block_max: list[float] = field(default_factory=list)
    top: float = 0.0

    def close(self) -> None:
        self.block_max = [max(self.impacts[i: i + BLOCK]) for i in range(0, len(self.impacts), BLOCK)]
        self.top = max(self.impacts)


def halves(text: bytes) -> tuple[bytes, bytes]:
    """Question and answer of an item: its last sentence is the answer, or its last third if there is only one."""
    parts = [p for p in SENTENCE.split(text.strip()) if p.strip()]
    if len(parts) > 1:
        return b" ".join(parts[:-1]), parts[-1]
    words = text.split()
    cut = len(words) - len(words) // 3
    return b" ".join(words[:cut]), b" ".join(words[cut:])


def words_held(grams: np.ndarray, here: np.ndarray, width: int) -> float:
    """Share of the words of a text, given by its runs of ``width`` words in order, that stand in a run found ``here``."""
    edges = np.zeros(len(grams) + width, dtype=np.int64)
    hit = np.flatnonzero(np.isin(grams, here))
    np.add.at(edges, hit, 1)
    np.add.at(edges, hit + width, -1)
    return float((np.cumsum(edges)[:-1] > 0).mean())


class Index:
    """BM25 over word runs of test items; impacts are shares of the score an item gets from its own text.

    A question of ``QUESTION`` words or more has postings of its own, by the shares of its own score, under the number of
    its item plus the number of items.
    """

    def __init__(self, items: list[tuple[int, bytes]]):
        self.ids = [i for i, _ in items]
        hashes = S.word_hashes([t for _, t in items])
        terms = [S.grams(h, TERM) for h in hashes]
        frequency: dict[int, int] = {}
        counted = [dict(zip(*(x.tolist() for x in np.unique(t, return_counts=True)))) for t in terms]
        for own in counted:
            for t in own:
                frequency[t] = frequency.get(t, 0) + 1
        n, mean = len(items), np.mean([len(t) for t in terms]) if items else 1.0
        parts = [halves(t) for _, t in items]
        questions = S.word_hashes([q for q, _ in parts])
        asked = [(n + item, S.grams(q, TERM)) for item, q in enumerate(questions) if QUESTION <= len(q) < len(hashes[item])]
        entries = list(zip(range(n), terms, counted))
        entries += [(e, t, dict(zip(*(x.tolist() for x in np.unique(t, return_counts=True))))) for e, t in asked]
        postings: dict[int, Postings] = {}
        for item, grams, own in entries:
            norm = K1 * (1 - B + B * len(grams) / mean)
            score = {t: np.log(1 + (n - frequency[t] + 0.5) / (frequency[t] + 0.5)) * c * (K1 + 1) / (c + norm)
                     for t, c in own.items()}
            total = sum(score.values())
            for t, s in score.items():
                held = postings.setdefault(t, Postings())
                held.items.append(item)
                held.impacts.append(float(s / total))
        self.terms = np.array(sorted(postings), dtype=np.uint64)
        self.postings = [postings[t] for t in self.terms.tolist()]
        for p in self.postings:
            p.close()
        self.maybe = np.zeros(PREFILTER, dtype=bool)
        self.maybe[self.terms % np.uint64(PREFILTER)] = True
        #: Widths of the terms; below TERM only for items of fewer words.
        self.widths = sorted({min(TERM, len(h)) for h in hashes})
        #: Of the whole item, its question and its answer: words of a shingle and the shingles, words of a run and the runs.
        self.checks = [
            [(min(WIDTH, len(h)), S.distinct(S.grams(h, WIDTH)), min(TERM, len(h)), S.grams(h, TERM)) for h in three]
            for three in zip(hashes, questions, S.word_hashes([a for _, a in parts]))]
        self.asks = [len(q) >= QUESTION for q in questions]
        longest = max((len(h) for h in hashes), default=0)
        self.passage = max(PASSAGE, 2 * longest)

    def found(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of known terms in a text, and their numbers."""
        places, numbers = [], []
        for width in self.widths:
            grams = S.grams(hashes, width) if len(hashes) >= width else hashes[:0]
            at = np.flatnonzero(self.maybe[grams % np.uint64(PREFILTER)])
            number = np.searchsorted(self.terms, grams[at]).clip(max=len(self.terms) - 1)
            same = self.terms[number] == grams[at]
            places.append(at[same])
            numbers.append(number[same])
        return (np.concatenate(places), np.concatenate(numbers)) if places else (np.zeros(0, int), np.zeros(0, int))

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """All items that score at least ``threshold`` for a passage with these distinct terms.

        Lists are kept in the order of their current item. The pivot is the first list where the lists' largest
        impacts reach the threshold; if the largest impacts of the blocks there don't, the lists move past the block
        that ends first, otherwise the item is scored.
        """
        lists = [[self.postings[t], 0] for t in terms]
        out = []
        while lists:
            lists.sort(key=lambda x: x[0].items[x[1]])
            bound, pivot = 0.0, None
            for i, (p, _) in enumerate(lists):
                bound += p.top
                if bound >= threshold - 1e-9:
                    pivot = i
                    break
            if pivot is None:
                break
            item = lists[pivot][0].items[lists[pivot][1]]
            while pivot + 1 < len(lists) and lists[pivot + 1][0].items[lists[pivot + 1][1]] == item:
                pivot += 1
            near = lists[:pivot + 1]
            spots = [bisect_left(p.items, item, at) for p, at in near]
            blocks = [(p, s // BLOCK) for (p, _), s in zip(near, spots) if s < len(p.items)]
            if sum(p.block_max[b] for p, b in blocks) >= threshold - 1e-9:
                total = sum(p.impacts[s] for (p, _), s in zip(near, spots) if s < len(p.items) and p.items[s] == item)
                if total >= threshold - 1e-9:
                    out.append((item, total))
                beyond = item + 1
            else:
                ends = [p.items[min(len(p.items), (b + 1) * BLOCK) - 1] + 1 for p, b in blocks]
                following = [lists[pivot + 1][0].items[lists[pivot + 1][1]]] if pivot + 1 < len(lists) else []
                beyond = max(item + 1, min(ends + following))
            for entry in near:
                entry[1] = bisect_left(entry[0].items, beyond, entry[1])
            lists = [x for x in lists if x[1] < len(x[0].items)]
        return out

    def held(self, check: tuple, here: dict[int, np.ndarray]) -> float:
        """The share of a text's five-word shingles, or of its words in runs of three, that a passage has; the larger."""
        width, shingles, run, runs = check
        whole = float(np.isin(shingles, here[width]).mean()) if width in here else 0.0
        # a shorter text has to be there whole
        return max(whole, words_held(runs, here[run], run)) if width == WIDTH and run in here else whole

    def leaked(self, item: int, whole: float, question: float, answer: float) -> bool:
        """Whether the whole passes, or the question on its own, or a weaker question with the answer to confirm it."""
        if whole >= OVERLAP:
            return True
        return self.asks[item] and (question >= OVERLAP or question >= WEAK and answer >= OVERLAP)

    def leaks(self, hashes: np.ndarray) -> dict[int, tuple]:
        """Items that a text holds: score, overlaps of the whole, the question and the answer, first word."""
        at, number = self.found(hashes)
        out: dict[int, tuple] = {}
        if not len(at):
            return out
        step = self.passage // 2
        for window in np.unique(np.concatenate([at // step, np.maximum(at // step - 1, 0)])):
            low = int(window) * step
            inside = (at >= low) & (at < low + self.passage)
            got = self.search(np.unique(number[inside]).tolist(), RETRIEVE) if inside.any() else []
            if not got:
                continue
            words = hashes[low: low + self.passage]
            best: dict[int, float] = {}
            for entry, score in got:
                item = entry % len(self.ids)
                best[item] = max(score, best.get(item, 0.0))
            here = {w: S.grams(words, w) for w in {x for item in best for c in self.checks[item] for x in (c[0], c[2])}
                    if 0 < w <= len(words)}
            for item, score in best.items():
                share = [self.held(c, here) for c in self.checks[item]]
                if self.leaked(item, *share) and share[0] > out.get(item, (0, -1.0))[1]:
                    out[item] = (score, *share, low)
        return out


def _searched(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            hashed = S.word_hashes(part.column("text").to_pylist())
            for doc_id, hashes in zip(part.column("id").to_pylist(), hashed):
                if len(hashes):
                    rows += [(doc_id, index.ids[item], *found) for item, found in index.leaks(hashes).items()]
        columns = list(zip(*rows)) or [[]] * 7
        kinds = [pa.int64(), pa.int64(), *[pa.float64()] * 4, pa.int64()]
        names = ["doc_id", "item_id", "score", "overlap", "question_overlap", "answer_overlap", "first_word"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


FOUND = ("doc_id long, item_id long, score double, overlap double, question_overlap double, answer_overlap double, "
         "first_word long")


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
          item_text_col: str = "text", index_items: int = INDEX_ITEMS) -> DataFrame:
    """A row for every document and test item that it holds.

    Every passage of every whole text, ``PASSAGE`` words or twice the longest item, is a query to a BM25 index of the
    items and their questions. Those at or above ``RETRIEVE`` of their own score are checked. An overlap is the share of
    five-word shingles that the passage holds, or if larger that of the words in shared runs of three, which one changed
    word leaves nearly whole. A leak has an overlap of ``OVERLAP`` of the item, or of its question if that has ``QUESTION``
    words, or of ``WEAK`` of such a question and ``OVERLAP`` of the answer. Items are indexed in blocks of
    about ``index_items``, each small enough for every executor, and all documents are searched for every block.

    Null and empty texts hold nothing; empty items are in nothing; an item shorter than five words must be there
    whole. Repeated rows give repeated results, equal items one row each. Other columns are ignored.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    out = None
    for index in indexes(items, item_col, item_text_col, index_items):
        found = texts.mapInArrow(partial(_searched, index=index), FOUND)
        out = found if out is None else out.union(found)
    return out


def indexes(items: DataFrame, item_col: str, text_col: str, index_items: int) -> Iterator[Index]:
    """An index for every block of about ``index_items`` items, one at least."""
    wanted = items.filter(F.length(F.trim(text_col)) > 0).select(
        F.col(item_col).cast("long").alias("item_id"), F.col(text_col).cast("binary").alias("text"))
    blocks = 1 + wanted.count() // index_items
    for block in range(blocks):
        rows = wanted.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id").collect()
        yield Index([(r["item_id"], bytes(r["text"])) for r in rows])


def _clean(batches: Iterator[pa.RecordBatch], index: Index, text_col: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            hashed = S.word_hashes(part.column(text_col).cast(pa.binary()).to_pylist())
            yield part.filter(pa.array([not index.leaks(h) for h in hashed], pa.bool_()))


def uncontaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id",
                   item_text_col: str = "text", index_items: int = INDEX_ITEMS) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no test item; see :func:`leaks`."""
    for index in indexes(items, item_col, item_text_col, index_items):
        docs = docs.mapInArrow(partial(_clean, index=index, text_col=text_col), docs.schema)
    return docs
