"""Counts tokens of whole texts: byte-pair merges on a heap over a linked list, without making identifiers."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache, partial
from heapq import heapify, heappop, heappush
from unicodedata import normalize

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from tokenizers import Tokenizer

from frameops.llm.encoder import COMMON, byte_letters

#: Counts of lower-case words remembered by a Python worker, so that a frequent one is merged once.
REMEMBERED = 800_000
#: White space as Unicode has it. Python's split() also takes the separators 0x1C to 0x1F, which are not in it.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
RUNS = regex.compile(f"[^{WHITE}]+")
SEPARATORS = regex.compile("[\x1c-\x1f]")


def merged_length(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Symbols left after merging adjacent pairs, lowest rank first and leftmost among equals."""
    n = len(symbols)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1)
            if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
    heapify(heap)
    merges = 0
    while heap:
        _, i, left, right = heappop(heap)
        j = after[i]
        # one of the two has been merged since
        if symbols[i] != left or j >= n or symbols[j] != right:
            continue
        merges += 1
        symbols[i], symbols[j] = left + right, ""
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get((symbols[i], symbols[k]))) is not None:
                heappush(heap, (r, i, symbols[i], symbols[k]))
        if (h := before[i]) >= 0 and (r := ranks.get((symbols[h], symbols[i]))) is not None:
            heappush(heap, (r, h, symbols[h], symbols[i]))
    return n - merges


class Counter:
    """Token counts of texts by a vocabulary file: NFC, lower case, split by its pattern, byte-level merges."""

    def __init__(self, vocabulary: str):
        self.vocabulary = vocabulary
        with open(vocabulary, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {pair: rank for rank, pair in enumerate(pairs)}
        self.suffix = model["end_of_word_suffix"] or ""
        self.letters = byte_letters()
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern = regex.compile(split.replace(r"\s", WHITE))
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]) or "(?!)")
        self.parts: dict[str, int] = {}

    @cached_property
    def library(self) -> Tokenizer:
        """Loaded by the first word that needs it."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        return Tokenizer.from_file(self.vocabulary)

    def _letters(self, letters: Iterable[str]) -> int:
        symbols = list(letters)
        symbols[-1] += self.suffix
        return merged_length(symbols, self.ranks)

    def _part(self, part: str) -> int:
        if (n := self.parts.get(part)) is None:
            n = self._letters([self.letters[b] for b in part.encode()])
            if len(self.parts) >= REMEMBERED:
                self.parts.clear()
            if len(part) < 100:
                self.parts[part] = n
        return n

    def _word(self, word: str) -> int:
        """Tokens of a run without white space; nothing in the file's rules reaches across white space."""
        if word.isascii():
            small = word.lower()
        elif COMMON.fullmatch(word):
            # letter by letter: no final sigma
            small = "".join(c.lower() for c in normalize("NFC", word))
        else:
            return self._rare(word)
        if small.isalpha():
            return self._part(small)
        if small[:-1].isalpha() and small[-1] in ".,;:!?":
            return self._part(small[:-1]) + self._part(small[-1])
        return sum(map(self._part, self.pattern.findall(small)))

    def _rare(self, word: str) -> int:
        """The same by the file's own normaliser and splitter, which may follow another version of Unicode than Python's tables."""
        small = self.library.normalizer.normalize_str(word)
        return sum(self._letters(letters) for letters, _ in self.library.pre_tokenizer.pre_tokenize_str(small))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if "<" in text and (found := len(self.special.findall(text))):
            return found + sum(map(self.count, self.special.split(text)))
        words = RUNS.findall(text) if SEPARATORS.search(text) else text.split()
        known = self.parts.get
        total = 0
        for word in words:
            # what is remembered is a single part, equal to its own lower case
            n = known(word)
            total += self._word(word) if n is None else n
        return total


@lru_cache(2)
def counter(vocabulary: str) -> Counter:
    return Counter(vocabulary)


def _counted(batches: Iterator[pa.RecordBatch], vocabulary: str) -> Iterator[pa.RecordBatch]:
    count = counter(vocabulary).count
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            texts = part.column("text")
            sizes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            tokens = pa.array([count(t.as_py()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), sizes, tokens], ["doc_id", "n_bytes", "n_tokens"])


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens`` and ``over_limit`` of every row of ``docs``.

    ``vocabulary`` is the path of a word-level byte-pair file that every executor has. No begin or end tokens
    are added; special strings inside texts count as one token each. A null text counts as empty: 0 and 0.
    Every row gives one row, repeated and null ids included; other columns are ignored. No shuffle.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(
        partial(_counted, vocabulary=vocabulary), "doc_id long, n_bytes long, n_tokens long"
    ).withColumn("over_limit", F.col("n_tokens") > limit)
