import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from frameops.llm import encoder, packing, token_counts

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", "a", "Don't STOP <|endoftext|> x<|startoftext|>y  <|endoftext|>", "a\x1cb \x1f c", "ΣΟΦΟΣ ΑΣ  İstanbul é ê  x y", "  lead\n\n\ttail  \n",
    "日本語 テスト 😀😀 x2³½", "'s 'S it'LL we'RE", "x" * 20_000, "\n\n\n  <|endoftext|>  z", "Ⅷ ٣٤ k̈ ​K İ r \x85s\xa0t　 u v", "ßäŒœ³²¼ЖжΩω–—“”…€",
]


def mixtures(n):
    rng = random.Random(5)
    parts = [" ", "  ", "\n", "\t", " \n", "a", "b's", "'LL", "é", ".", "the", ",", "12", "\x1c", "\x85", "€", "—", "<|endoftext|>"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(n)]


def test_counts_equal_the_library(documents, document_rows):
    library = Tokenizer.from_file(WORDS)
    counter = token_counts.Counter(WORDS)
    for text in ODD + mixtures(3000):
        assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids), text[:100]
    got = {r.doc_id: tuple(r)[1:] for r in token_counts.token_counts(documents, WORDS).collect()}
    for i, text in document_rows:
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert got[i] == (len(text.encode()), n, n > 2048)


def test_counts_on_every_code_point():
    """Alone and between letters, digits and signs."""
    library, counter = Tokenizer.from_file(WORDS), token_counts.Counter(WORDS)
    every = [chr(x) for x in range(1, 0x110000) if not 0xD800 <= x < 0xE000]
    for at in range(0, len(every), 64):
        part = every[at: at + 64]
        text = "".join(f"a{c}1{c}.{c} {c}\n" for c in part)
        if counter.count(text) != len(library.encode(text, add_special_tokens=False).ids):
            wrong = [c for c in part if counter.count(f"a{c}1{c}.{c} {c}\n") != len(library.encode(f"a{c}1{c}.{c} {c}\n", add_special_tokens=False).ids)]
            raise AssertionError([hex(ord(c)) for c in wrong])


def test_counts_of_awkward_rows(awkward, nothing):
    got = token_counts.token_counts(awkward, WORDS).collect()
    assert len(got) == 13 and sum(r.n_tokens == 0 and r.n_bytes == 0 for r in got) == 3
    assert token_counts.token_counts(nothing, WORDS).collect() == []


def test_merges_lowest_rank_first():
    ranks = {("b", "c"): 0, ("a", "b"): 1, ("a", "bc"): 2, ("x", "x"): 3, ("xx", "xx"): 4}
    assert token_counts.merged_length(list("abc"), ranks) == 1
    assert token_counts.merged_length(list("ab"), ranks) == 1
    assert token_counts.merged_length(list("xxxxx"), ranks) == 2
    assert token_counts.merged_length(["a"], ranks) == 1


def test_ids_equal_the_library(document_rows):
    library, own = Tokenizer.from_file(BYTES), encoder.Encoder(BYTES)
    for text in ODD + mixtures(3000) + [t for _, t in document_rows]:
        assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, text[:100]


def checked(rows, texts, capacity=1024):
    """Every id of every document is in one piece, every sequence is gapless and within the limit."""
    library = Tokenizer.from_file(BYTES)
    by_doc, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, text in texts:
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        own = sorted(by_doc[i], key=lambda r: r["piece"])
        at = 0
        for k, r in enumerate(own):
            part = np.array(ids[at: at + r["length"]], dtype="<u4")
            assert (r["piece"], r["start"], r["ids_crc32"]) == (k, at, zlib.crc32(part))
            assert r["length"] == capacity or k == 0
            at += r["length"]
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return sequences


def test_packing_is_whole_and_tight(documents, document_rows):
    rows = packing.pack_documents(documents, BYTES).collect()
    sequences = checked(rows, document_rows)
    assert len(sequences) <= 1.01 * -(-sum(r["length"] for r in rows) // 1024) + 1


def test_packing_awkward_rows(awkward, nothing):
    rows = packing.pack_documents(awkward, BYTES, group_pieces=4).collect()
    assert Counter(r.doc_id for r in rows if r.piece == 0) == Counter([1, 2, 3, None, None, 4, 5, 5, 6, 7, 8, 9, 10])
    assert all(r.length == 1 for r in rows if r.doc_id in (1, 2))
    assert packing.pack_documents(nothing, BYTES).collect() == []


def test_best_fit_keeps_every_constraint():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 100, 500)
    for rule in ("residual_norm", "dot_product"):
        for limits in (np.array([100, 100, 1e4]), np.array([100, 3, 1e4]), np.array([100, 100, 9900.0])):
            bins, offsets = packing.best_fit(lengths, limits, np.array([1.0, 0.05, 0.05]), rule)
            for b in set(bins.tolist()):
                own = lengths[bins == b]
                assert own.sum() <= limits[0] and len(own) <= limits[1] and (own**2).sum() <= limits[2]
                assert sorted(offsets[bins == b].tolist()) == np.cumsum([0, *sorted(own, reverse=True)])[:-1].tolist()
    assert len(set(packing.best_fit(np.array([60, 40, 50, 50, 30, 70]), np.array([100, 9, 1e4]), np.ones(3), "residual_norm")[0])) == 3


def test_cut():
    assert packing.cut(1, 4) == [(0, 1)] and packing.cut(4, 4) == [(0, 4)]
    assert packing.cut(9, 4) == [(0, 1), (1, 4), (5, 4)]
