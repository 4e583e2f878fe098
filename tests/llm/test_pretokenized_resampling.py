import math
import random
import re
from collections import Counter
from hashlib import sha256
from zlib import crc32

import duckdb
import pytest

from frameops.llm import pretokenized_resampling as R
from frameops.llm import queries

SF = "/root/testdata/sf0.01"
WORD = re.compile(R.WORD)


def lowered(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def plain(docs, target, longest=1, percent=10):
    """Rows (doc_id, n_features, weight, score, rank) worked out one document at a time."""
    def features(text):
        words = WORD.findall(lowered(text))
        return words, [" ".join(words[i: i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]

    bucket = lambda f: crc32(f.encode()) % 10_000
    s = Counter(bucket(f) for _, text in docs for f in features(text)[1])
    t = Counter(bucket(f) for _, text in target for f in features(text)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    rows = []
    for i, text in docs:
        words, own = features(text)
        gains = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000)))) for b in map(bucket, own)]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)))
    able = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = [(*r[:4], k + 1 if k < percent * len(able) // 100 else None) for k, r in enumerate(able)]
    return ranks + [(*r[:4], None) for r in rows if r[4] < 20]


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is None, x or 0) for x in r))


def test_words_equal_the_expression():
    rng = random.Random(2)
    ranges = [(0, 128), (0, 128), (128, 0x500), (0xE000, 0x11000)]
    for _ in range(3000):
        text = "".join(chr(rng.randrange(*rng.choice(ranges))) for _ in range(rng.randrange(30)))
        low, places = R.words(text.encode())
        assert low == lowered(text) and [low[a:b] for a, b in places] == WORD.findall(low)


def test_windows():
    low, places = R.words(b"One, two  THREE")
    assert list(R.windows(low, places, 3)) == ["one", "two", "three", "one two", "two three", "one two three"]
    assert list(R.windows(*R.words(None), 2)) == []


def test_query_equals_plain_version_and_sql(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    target = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    got = ordered(queries.op13_target_resampling(spark, SF).collect())
    assert got == ordered(plain(docs, target))
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    assert got == ordered(con.execute(R.SQL).fetchall())


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_longer_features(spark, documents, document_rows, table, longest):
    target = table("benchmark")
    got = R.resample(documents, target, longest).collect()
    assert ordered(got) == ordered(plain(document_rows, [tuple(r) for r in target.collect()], longest))


def test_one_id_in_a_third_of_all_rows(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(7 if i % 3 == 0 else i, text + (f" x{i}" if i % 3 else "")) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    target = spark.createDataFrame([(1, "w1 w2 x5")], "item_id long, text string")
    got = R.resample(docs, target).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 301))
    want = ordered((*r[:4], r[4] is None) for r in plain(rows, [(1, "w1 w2 x5")]))
    assert ordered((*r[:4], r[4] is None) for r in got) == want


def test_awkward_rows(spark, awkward, nothing, table):
    target = table("benchmark")
    got = R.resample(awkward, target).collect()
    docs = [(r.doc_id, r.text) for r in awkward.collect()]
    assert ordered(got) == ordered(plain(docs, [tuple(r) for r in target.collect()]))
    featured = R.features(awkward)
    everyone = R.draw(R.weigh(featured, R.gains(R.histogram(featured), R.histogram(featured))), percent=100)
    assert sorted(r["rank"] for r in everyone.collect() if r["rank"]) == list(range(1, 1 + everyone.filter("n_words >= 20").count()))
    assert R.resample(nothing, target).collect() == []
    assert R.resample(awkward, nothing).count() == len(docs)
    assert R.resample(nothing, nothing).schema == R.resample(awkward, target).schema
