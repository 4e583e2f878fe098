"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier on its posteriors."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from frameops.llm.sieve import sieved
from frameops.llm.store import stored

#: Labelled documents the model is fitted on at most, picked by a hash of their ids.
MAX_LABELLED = 10_000
MAX_FEATURES = 1500
MAX_VOTERS = 96
#: Least likelihood-ratio statistic of a word or stem that may vote.
EVIDENCE = 25.0
STEMS = (3, 4, 5, 6, 7, 8)
SEED = 3
WORDS = re.compile(r"\w+")
REMEMBERED = 150_000
# fixed values: insults that are toxic without any label
LEXICON = ("bastard", "clown", "crap", "disgusting", "dumb", "filth", "fool", "freak", "garbage", "idiot", "imbecile", "jerk",
           "loser", "moron", "pathetic", "pig", "scum", "shit", "stupid", "trash", "ugly", "vermin", "worthless")


def stems_of(word: str) -> list[str]:
    """A word itself and its stems. A stem catches forms that no label shows."""
    return [f"{word} ", *(word[:k] for k in STEMS if len(word) >= k)]


def levels(stem: str, count: int, size: int) -> Iterator[str]:
    """Features of a text of ``size`` distinct words, ``count`` of them with the stem: one, some, or many for its length."""
    yield stem
    if count > 1:
        yield f"{stem}#2"
    if count > 2:
        yield f"{stem}#3"
    if count > 1 and count * 100 >= size:
        yield f"{stem}#%"


def words_of(text: str | None) -> set[str]:
    return set(WORDS.findall(text.lower())) if text else set()


def features_of(text: str | None) -> Iterator[str]:
    words = words_of(text)
    for stem, n in Counter(chain.from_iterable(map(stems_of, words))).items():
        yield from levels(stem, n, len(words))


def _tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with and without the label, per feature, summed within a task."""
    def flush(tally: dict[int, Counter]) -> pa.RecordBatch:
        names = list(tally[0] | tally[1])
        return pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), *(pa.array([tally[k][x] for x in names], pa.int64()) for k in (1, 0))],
            ["feature", "toxic", "clean"])

    tally = {0: Counter(), 1: Counter()}
    for batch in batches:
        for text, label in zip(batch.column("text"), batch.column("label").to_pylist()):
            tally[label].update(features_of(text.as_py()))
            if len(tally[0]) + len(tally[1]) > 150_000:
                yield flush(tally)
                tally = {0: Counter(), 1: Counter()}
    yield flush(tally)


class Hits(dict):
    """Stems of a word that have a feature."""

    def __init__(self, features: list[str]):
        super().__init__()
        self.ids = {f: i for i, f in enumerate(features)}
        self.stems = {f.split("#")[0] for f in features}

    def __missing__(self, word: str) -> tuple[str, ...]:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = tuple(s for s in stems_of(word) if s in self.stems)
        return found

    def of(self, text: str | None) -> tuple[set[int], int]:
        """Features of a text, and how many of its distinct words have a stem with one."""
        words = words_of(text)
        found = [x for x in map(self.__getitem__, words) if x]
        counts = Counter(chain.from_iterable(found))
        return {self.ids[f] for s, n in counts.items() for f in levels(s, n, len(words)) if f in self.ids}, len(found)


@dataclass
class Model:
    features: list[str]
    weights: np.ndarray
    bias: float

    def score(self, ids: set[int]) -> float:
        return 1.0 / (1.0 + float(np.exp(-np.clip(self.bias + self.weights[list(ids)].sum(), -500, 500))))


def votes(ids: list[set[int]], words: list[int], features: list[str]) -> np.ndarray:
    """A row per document, a column per voter: single features, the lexicon, and patterns of several hits."""
    singles = min(len(features), MAX_VOTERS)
    known = {features.index(f) for x in LEXICON if (f := f"{x} ") in features}
    out = np.zeros((len(ids), singles + 4))
    for i, (found, n) in enumerate(zip(ids, words)):
        out[i, [f for f in found if f < singles]] = 1
        out[i, singles:] = bool(found & known), n >= 2, n >= 4, not found
    return out


def label_model(votes: np.ndarray, start: np.ndarray, rounds: int = 15) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of the toxic class of every row, and how often each voter votes given either class.

    Expectation-maximisation from ``start``. Voters are not independent: the correlation that is left between
    two of them given the class counts as a share of a common voter, so a clique of voters weighs as one.
    """
    p = start.copy()
    for _ in range(rounds):
        toxic = (votes * p[:, None]).sum(0) + 0.5
        clean = (votes * (1 - p)[:, None]).sum(0) + 0.5
        alpha, beta = toxic / (p.sum() + 1), clean / ((1 - p).sum() + 1)
        rest = votes - np.outer(p, alpha) - np.outer(1 - p, beta)
        spread = np.sqrt((rest**2).mean(0)) + 1e-9
        correlation = np.clip(rest.T @ rest / len(votes) / np.outer(spread, spread), 0, 1)
        weight = 1 / correlation.sum(0).clip(1)
        prior = np.clip(p.mean(), 1e-4, 1 - 1e-4)
        odds = np.log(prior / (1 - prior)) + votes @ (weight * np.log(alpha / beta)) + (1 - votes) @ (
            weight * np.log((1 - alpha) / (1 - beta)))
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return p, alpha, beta


def linear(x: np.ndarray, target: np.ndarray, penalty: float = 1e-4, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by accelerated gradient steps; weights are not negative."""
    w, b = np.zeros(x.shape[1], dtype=x.dtype), 0.0
    v, c = w.copy(), b
    rate = 4.0 / (1 + float((x**2).sum(1).mean()))
    for k in range(rounds):
        error = 1 / (1 + np.exp(-(x @ v + c))) - target
        w_next = np.maximum(v - rate * (x.T @ error / len(x) + penalty * v), 0)
        b_next = c - rate * float(error.mean())
        v, c = w_next + k / (k + 3) * (w_next - w), b_next + k / (k + 3) * (b_next - b)
        w, b = w_next, b_next
    return w, b


def held_out(id_col: str):
    """Documents that no model learns from: crc32 of the id as text divides by five."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def _matched(batches: Iterator[pa.RecordBatch], features: list[str]) -> Iterator[pa.RecordBatch]:
    hits = Hits(features)
    for batch in batches:
        found = [hits.of(t.as_py()) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([
            batch.column("label"), pa.array([sorted(i) for i, _ in found], pa.list_(pa.int32())),
            pa.array([n for _, n in found], pa.int32())], ["label", "ids", "words"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        max_labelled: int = MAX_LABELLED) -> Model:
    """A model from labelled documents outside the held-out fifth.

    At most ``max_labelled`` documents, the first by a hash of their id, are looked at. Their words and
    stems with the strongest evidence become voters and features. Labels start the label model; what the classifier
    learns are its posteriors. Without labels of both classes the lexicon alone decides.
    """
    lexicon = Model([f"{x} " for x in LEXICON], np.full(len(LEXICON), 6.0), -4.0)
    sample = stored(
        labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(id_col))
        .groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
        .orderBy(F.xxhash64("id", F.lit(SEED)), "id").limit(max_labelled))
    rows = stored(
        sieved(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), sample, "id")
        .join(sample, "id").select("text", "label"))
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return lexicon
    # log-likelihood ratio of the feature's two document frequencies, for features commoner in toxic documents
    a, b = F.col("toxic"), F.col("clean")
    share = n1 / (n1 + n0)
    term = lambda n, of: F.when(n > 0, n * F.log(n / of)).otherwise(0.0)
    absent = n1 + n0 - a - b
    evidence = 2 * (term(a, (a + b) * share) + term(b, (a + b) * (1 - share))
                    + term(n1 - a, absent * share) + term(n0 - b, absent * (1 - share)))
    best = (
        rows.mapInArrow(_tallied, "feature string, toxic long, clean long")
        .groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .filter(a * n0 > b * n1 * 4).withColumn("evidence", evidence).filter(F.col("evidence") >= EVIDENCE)
        .orderBy(F.desc("evidence"), "feature").limit(MAX_FEATURES).collect()
    )
    features = [r["feature"] for r in best]
    features += [f for x in LEXICON if (f := f"{x} ") not in features]
    found = rows.mapInArrow(partial(_matched, features=features), "label int, ids array<int>, words int").collect()
    ids = [set(r["ids"]) for r in found]
    labelled = np.array([r["label"] for r in found], dtype=float)
    cast = votes(ids, [r["words"] for r in found], features)
    # the label is one more voter, and the start
    posterior, _, _ = label_model(np.column_stack([cast, labelled]), 0.05 + 0.9 * labelled)
    x = np.zeros((len(ids), len(features)), dtype=np.float32)
    for i, own in enumerate(ids):
        x[i, list(own)] = 1
    weights, bias = linear(x, posterior.astype(np.float32))
    # an insult that no label shows still counts
    for i, f in enumerate(features):
        if f.strip() in LEXICON and f.endswith(" ") and not x[:, i].any():
            weights[i] = max(weights[i], 1.0 - bias)
    return Model(features, weights.astype(float), float(bias))


def _scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    hits = Hits(model.features)
    for batch in batches:
        scores = [model.score(hits.of(t.as_py())[0]) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(scores, pa.float64())], ["id", "score"])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every row of ``docs``.

    Null and empty texts get the score of a text without any feature. Rows with a repeated or null id are
    scored like any other; a null id is not held out. Other columns are not looked at.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return (
        rows.mapInArrow(partial(_scored, model=model), "id long, score double")
        .select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score",
                (F.col("score") >= 0.5).cast("int").alias("predicted"))
    )


def _accepted(batches: Iterator[pa.RecordBatch], model: Model, text_col: str) -> Iterator[pa.RecordBatch]:
    hits = Hits(model.features)
    for batch in batches:
        fine = [model.score(hits.of(t.as_py())[0]) < 0.5 for t in batch.column(text_col)]
        yield batch.filter(pa.array(fine, pa.bool_()))


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that score below one half."""
    return docs.mapInArrow(partial(_accepted, model=model, text_col=text_col), docs.schema)
