"""Secrets: a trigram inverted index picks the documents in which a rule's pattern is tried. Built-in functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from frameops.llm.sieve import sieved
from frameops.llm.spans import SPAN, count_of, keyed, located, written
from frameops.llm.store import stored
from frameops.llm.trigrams import Query, query


@dataclass(frozen=True)
class Rule:
    """A kind of secret; ``group`` of a match must have ``least`` characters."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0
    base: bool = False


# fixed values: the kinds and patterns of secrets, in the order in which spans at one place are listed
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", 8, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 16, 0, True),
    Rule("hex", r"[0-9a-f]{32,}", 32, 0, True),
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abp]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)


def queries(rules: tuple[Rule, ...]) -> dict[str, Query]:
    return {r.kind: query(r.pattern) for r in rules}


def postings(docs: DataFrame, grams: list[str]) -> DataFrame:
    """The inverted index as rows ``gram``, ``key``, ``check``: which documents hold which of the rules' trigrams."""
    small = F.lower("text")
    held = F.array_compact(F.array(*(F.when(F.contains(small, F.lit(g)), F.lit(g)) for g in grams)))
    return docs.select("key", "check", F.explode(held).alias("gram"))


def candidates(index: DataFrame, wanted: dict[str, Query], spark: SparkSession) -> DataFrame:
    """``key``, ``check`` and ``kind`` of documents whose postings satisfy a rule's query.

    Postings of one alternative are intersected by counting them, alternatives of a run are united, and all
    runs of the rule must hold. Counts are combined before the shuffle and keyed by document, so a trigram that a third
    of all documents hold gathers nowhere.
    """
    terms = [(kind, run, alternative, gram, len(needed))
             for kind, runs in wanted.items() for run, alternatives in enumerate(runs)
             for alternative, needed in enumerate(alternatives) for gram in sorted(needed)]
    runs = [(kind, len(r)) for kind, r in wanted.items()]
    # both bounded by the rules
    terms = F.broadcast(spark.createDataFrame(terms, "kind string, run int, alternative int, gram string, needed int"))
    runs = F.broadcast(spark.createDataFrame(runs, "kind string, runs int"))
    return (
        index.join(terms, "gram")
        .groupBy("key", "check", "kind", "run", "alternative").agg(
            F.count(F.lit(1)).alias("n"), F.first("needed").alias("needed"))
        .filter("n = needed")
        .groupBy("key", "check", "kind").agg(F.count_distinct("run").alias("held"))
        .join(runs, "kind").filter("held = runs").select("key", "check", "kind")
    )


def _matches(text: Column, rule: Rule, tried: Column) -> Column:
    spans = located(text, rule.pattern, rule.kind, tried)
    if rule.group:
        groups = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
        return F.when(F.size(spans) > 0, F.transform(
            F.filter(F.arrays_zip(spans.alias("span"), groups.alias("group")), lambda x: F.length(x["group"]) >= rule.least),
            lambda x: x["span"])).otherwise(spans)
    return F.filter(spans, lambda s: F.length(s["value"]) >= rule.least)


def _listed(spans: Column, rules: tuple[Rule, ...]) -> Column:
    """Spans by start, then by the order of the rules."""
    order = F.create_map(*(x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))))
    sortable = F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), order[s["kind"]].alias("at"), s["kind"].alias("kind"), s["end"].alias("end"),
        s["value"].alias("value")))
    return F.transform(F.array_sort(sortable), lambda s: F.struct(s["kind"], s["start"], s["end"], s["value"]))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id`` and ``spans`` of every row of ``docs``, by start and then by the order of the rules.

    Every rule's pattern gives a Boolean query of trigrams, in lower case. An index of those trigrams gives the
    documents that satisfy a query, and the pattern is tried on these; a rule without mandatory trigrams is tried on all.
    Texts are read whole and not shuffled but for candidates.

    Null and empty texts have no spans. Every row gives one row; rows that are equal have equal spans. Other
    columns are ignored, an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = keyed(docs, id_col, text_col)
    wanted = queries(rules)
    indexed, scanned = [r for r in rules if wanted[r.kind]], [r for r in rules if not wanted[r.kind]]
    grams = sorted({g for r in indexed for run in wanted[r.kind] for needed in run for g in needed})
    everywhere = F.concat(*(_matches(F.col("text"), r, F.lit(True)) for r in scanned)) if scanned else \
        F.array().cast(f"array<{SPAN}>")
    seen = rows.select("doc_id", "key", "check", everywhere.alias("spans"))
    if not indexed:
        return seen.select("doc_id", _listed(F.col("spans"), rules).alias("spans"))
    picked = stored(
        candidates(postings(rows, grams), {r.kind: wanted[r.kind] for r in indexed}, spark)
        .groupBy("key", "check").agg(F.collect_set("kind").alias("kinds")))
    tried = sieved(rows, picked, "key").join(picked, ["key", "check"])
    verified = tried.select("key", "check", F.concat(*(
        _matches(F.col("text"), r, F.array_contains("kinds", r.kind)) for r in indexed)).alias("found"))
    verified = verified.filter(F.size("found") > 0).dropDuplicates(["key", "check"])
    spans = F.concat("spans", F.coalesce("found", F.array().cast(f"array<{SPAN}>")))
    return seen.join(verified, ["key", "check"], "left").select("doc_id", _listed(spans, rules).alias("spans"))


def digest(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts of the base kinds, the hash of the base spans and all spans as text, per document."""
    base = [r.kind for r in rules if r.base]
    counts = [count_of(k).cast("long").alias(f"n_{k}") for k in base]
    own = F.filter("spans", lambda s: s["kind"].isin(*base))
    return found.select("doc_id", *counts, F.sha2(written(own), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
