import random
from hashlib import sha256

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from frameops.llm import bpe, queries

BYTES = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTES)


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    letters = [chr(x) for x in range(1, 0x3000)] + [chr(rng.randrange(0xE000, 0x110000)) for _ in range(3000)]
    plain = [*" ab1.\n\t'", "  ", "'ll", "<|endoftext|>", "<|endof"]
    return ["".join(rng.choice(letters) if rng.random() < 0.4 else rng.choice(plain) for _ in range(rng.randrange(1, 30))) for _ in range(n)]


def test_lowest_rank_first_and_stale_entries_skipped():
    # a b c d; ab and bc compete, abcd needs both
    ranks, products = {(1, 2): 1, (0, 1): 0, (2, 3): 2, (4, 6): 3}, [4, 5, 6, 7]
    assert bpe.merged([0, 1, 2, 3], ranks, products) == [7]
    assert bpe.merged([1, 2, 3], ranks, products) == [5, 3]
    assert bpe.merged([0, 0, 0, 0, 0], {(0, 0): 0, (1, 1): 1}, [1, 2]) == [2, 0]
    assert bpe.merged([], ranks, products) == [] and bpe.merged([3], ranks, products) == [3]


def test_ids_and_texts_equal_the_library(library):
    codec = bpe.Codec(BYTES)
    texts = odd_texts(4000) + ["", "x" * 30_000, " " * 3000, "ab" * 9000, "<|endoftext|>" * 2, "a\0b", "<|endoftext|> \n\n <|endoftext|>"]
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert codec.encode(text) == ids, text[:60]
        for part in (ids, ids[len(ids) // 2:], ids[1:-1]):
            assert codec.decode(part) == library.decode(part, skip_special_tokens=False), text[:60]
            assert codec.decode(part, True) == library.decode(part, skip_special_tokens=True), text[:60]


def test_unknown_ids_spell_nothing(library):
    codec = bpe.Codec(BYTES)
    assert codec.decode([60_000, 64, 70_000]) == library.decode([60_000, 64, 70_000]) == codec.decode([64])
    assert codec.decode(None) == codec.decode([]) == ""


def test_every_code_point_alone_and_between_others(library):
    codec = bpe.Codec(BYTES)
    every = [chr(x) for x in range(1, 0x110000) if not 0xD800 <= x < 0xE000]
    for at in range(0, len(every), 64):
        text = "".join(f"a{c}1{c}.{c} {c}\n" for c in every[at: at + 64])
        assert codec.encode(text) == library.encode(text, add_special_tokens=False).ids, hex(at)


def test_other_kinds_of_files_are_refused():
    with pytest.raises(ValueError):
        bpe.Codec(public_tokenizers.path("word_bpe_49k.json"))


def test_query_equals_the_library(spark, document_rows, library):
    got = {r.doc_id: tuple(r)[1:] for r in queries.op11_bpe_codec(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(document_rows)
    for i, text in document_rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want = len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256(back.encode()).hexdigest()
        assert got[i] == want


def test_awkward_rows(awkward, nothing):
    decoded = bpe.decode(bpe.encode(awkward, BYTES), BYTES)
    rows = decoded.collect()
    texts = [r.text or "" for r in awkward.collect()]
    assert sorted(r.text for r in rows) == sorted(texts)
    empty = sha256(b"").hexdigest()
    digests = bpe.digest(decoded).collect()
    assert sum((r.n_tokens, r.ids_sha256, r.decoded_sha256) == (0, empty, empty) for r in digests) == texts.count("")
    assert bpe.digest(bpe.decode(bpe.encode(nothing, BYTES), BYTES)).collect() == []
