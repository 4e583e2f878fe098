"""Byte-pair encoding of whole texts with a priority queue of merge ranks over a linked list, and decoding."""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import cached_property, lru_cache, partial
from heapq import heapify, heappop, heappush
from itertools import chain
from unicodedata import category

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from frameops.llm.encoder import COMMON, byte_letters

#: Encoded words that a Python worker remembers in each of two generations, each shorter than SHORT characters.
REMEMBERED = 300_000
SHORT = 40
ROWS = 200


def _split(letters: str, digits: str) -> re.Pattern:
    """How the byte-level pre-tokenizer parts texts whose letters and digits are all among the given ones."""
    return re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{letters}]+| ?[{digits}]+| ?[^\s{letters}{digits}]+|\s+(?!\S)|\s+")


def _common(kind: str) -> str:
    """Letters (``L``) or digits (``N``) beyond ASCII that are common: on these all versions of Unicode agree."""
    return "".join(c for c in map(chr, range(128, 0x2100)) if COMMON.fullmatch(c) and category(c)[0] == kind)


ASCII_WORDS = _split("A-Za-z", "0-9")
COMMON_WORDS = _split("A-Za-z" + _common("L"), "0-9" + _common("N"))


class Remembered(dict):
    """Ids of words. When one generation is full the one before it goes; a word in use moves to the newer one."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.older = encode, {}

    def __missing__(self, word: str) -> list[int]:
        ids = self.older.get(word)
        if ids is None:
            ids = self.encode(word)
        if len(word) < SHORT:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids


def merged(symbols: list[int], ranks: dict[tuple[int, int], int], products: list[int]) -> list[int]:
    """Symbols after merging adjacent pairs, always the lowest rank first and the leftmost among equals.

    ``ranks`` gives the rank of a pair, ``products`` the symbol that a rank makes. The queue holds (rank, place of
    the left symbol); an entry is stale, and skipped, when the pair now standing at its place has another rank.
    Symbols are a doubly linked list, so a merge costs the logarithm of the length.
    """
    n = len(symbols)
    symbols = [*symbols]
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    queue = [(rank, i) for i in range(n - 1) if (rank := ranks.get((symbols[i], symbols[i + 1]))) is not None]
    heapify(queue)
    while queue:
        rank, i = heappop(queue)
        j = after[i]
        if j >= n or ranks.get((symbols[i], symbols[j])) != rank:
            continue
        symbols[i], symbols[j] = products[rank], -1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (right := ranks.get((symbols[i], symbols[k]))) is not None:
                heappush(queue, (right, i))
        if (h := before[i]) >= 0 and (left := ranks.get((symbols[h], symbols[i]))) is not None:
            heappush(queue, (left, h))
    return [s for s in symbols if s >= 0]


class Spelt(dict):
    """Bytes of ids; an unknown id has none."""

    def __missing__(self, _: int) -> bytes:
        return b""


class Codec:
    """Ids of texts and texts of ids by a byte-level vocabulary file, as the ``tokenizers`` library gives them.

    A file with another kind of model, a normaliser or added tokens that swallow their surroundings is refused.
    """

    def __init__(self, vocabulary: str):
        self.vocabulary = vocabulary
        with open(vocabulary, encoding="utf-8") as file:
            spec = json.load(file)
        model, splitter, added = spec["model"], spec["pre_tokenizer"] or {}, spec["added_tokens"]
        plain = splitter.get("type") == "ByteLevel" and splitter["use_regex"] and not splitter["add_prefix_space"]
        whole = model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("ignore_merges") or model.get("dropout")
        if model["type"] != "BPE" or whole or spec["normalizer"] or not plain:
            raise ValueError(f"{vocabulary} is not a plain byte-level vocabulary")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError(f"{vocabulary} has added tokens that depend on what surrounds them")
        ids = model["vocab"]
        letters = byte_letters()
        self.bytes_of = {letter: byte for byte, letter in enumerate(letters)}
        self.first = [ids[letter] for letter in letters]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {(ids[a], ids[b]): rank for rank, (a, b) in enumerate(pairs)}
        self.products = [ids[a + b] for a, b in pairs]
        self.added = {t["content"]: t["id"] for t in added}
        self.skipped = {t["id"] for t in added if t["special"]}
        longest_first = sorted(filter(None, self.added), key=len, reverse=True)
        self.boundaries = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if longest_first else None
        self.strings = Spelt({i: self._spelt(token) for token, i in (ids | self.added).items()})
        self.words = Remembered(self._word)

    @cached_property
    def pre_tokenizer(self):
        """The file's own splitter, for letters whose class may differ between versions of Unicode."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        return Tokenizer.from_file(self.vocabulary).pre_tokenizer

    def _spelt(self, token: str) -> bytes:
        """A vocabulary string as bytes: by its stand-ins, or as it is where it holds other letters."""
        found = [self.bytes_of.get(letter) for letter in token]
        return token.encode() if None in found else bytes(found)

    def _word(self, word: str) -> list[int]:
        return merged([self.first[b] for b in word.encode()], self.ranks, self.products)

    def _parts(self, text: str) -> list[str]:
        if COMMON.fullmatch(text):
            return (ASCII_WORDS if text.isascii() else COMMON_WORDS).findall(text)
        return [text[start:end] for _, (start, end) in self.pre_tokenizer.pre_tokenize_str(text)]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        for part in self.boundaries.split(text) if self.boundaries else [text]:
            if (special := self.added.get(part)) is not None:
                out.append(special)
            elif part:
                out += chain.from_iterable(map(self.words.__getitem__, self._parts(part)))
        return out

    def decode(self, ids: list[int] | None, skip_special: bool = False) -> str:
        """Vocabulary strings one after the other; unknown ids give nothing, bytes that are no UTF-8 a replacement mark."""
        ids = ids or []
        if skip_special:
            ids = [i for i in ids if i not in self.skipped]
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", errors="replace")


@lru_cache(2)
def codec(vocabulary: str) -> Codec:
    return Codec(vocabulary)


def _encoded(batches: Iterator[pa.RecordBatch], vocabulary: str) -> Iterator[pa.RecordBatch]:
    encode = codec(vocabulary).encode
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            flat, ends = array("i"), [0]
            for text in part.column("text"):
                flat.extend(encode(text.as_py()))
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, dtype=np.int32)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids], ["doc_id", "token_ids"])


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``token_ids`` (array of int) of every row of ``docs``; no begin or end tokens are added.

    ``vocabulary`` is the path of a byte-level vocabulary file that every executor has. Strings of special tokens inside
    texts become those tokens. Null and empty texts have no tokens. Every row gives one row, repeated and null
    ids included; other columns are ignored; an empty table gives an empty one. No shuffle.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(partial(_encoded, vocabulary=vocabulary), "doc_id long, token_ids array<int>")


def _decoded(batches: Iterator[pa.RecordBatch], vocabulary: str, skip_special: bool) -> Iterator[pa.RecordBatch]:
    decode = codec(vocabulary).decode
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            # not as_py(), which makes a Python object of every id by itself
            found = (ids.values.to_numpy(zero_copy_only=False).tolist() if ids.is_valid else None for ids in part.column("token_ids"))
            texts = pa.array([decode(ids, skip_special) for ids in found], pa.string())
            yield pa.RecordBatch.from_arrays([*part.columns, texts], [*part.schema.names, "text"])


def decode(tokens: DataFrame, vocabulary: str, skip_special: bool = False) -> DataFrame:
    """``tokens`` (``doc_id``, ``token_ids``) with the ``text`` that the ids spell; null ids spell an empty text."""
    rows = tokens.select("doc_id", "token_ids")
    run = partial(_decoded, vocabulary=vocabulary, skip_special=skip_special)
    return rows.mapInArrow(run, "doc_id long, token_ids array<int>, text string")


def digest(decoded: DataFrame) -> DataFrame:
    """Per row: ``doc_id``, ``n_tokens``, and sha256 of the ids in decimal joined by commas and of the decoded text."""
    return decoded.select(
        "doc_id", F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("token_ids", ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
