"""Personal data: fixed patterns, and identifiers that induced contexts find. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from frameops.llm.sieve import parted
from frameops.llm.spans import CONTEXT, SPAN, count_of, digits, keyed, located, passes_luhn, written
from frameops.llm.store import dropped, stored

KINDS = ("email", "ip", "card", "phone")
#: Runs are entered at their start, or where the last match ended, so that long runs are read once.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
#: A word with a digit or an at sign may be an identifier.
IDENTIFIER = r"(?:\G|(?<!\S))[^\s0-9@]*+[0-9@]\S*+"
LEFT = r"(\S+\s+\S+)\s+$"
LAST = r"(\S+)\s+$"
RIGHT = r"^\s+(\S+)"
#: Context words of their own; those of a text are lower case.
START, END = "START", "END"
#: Characters of a cell in which base spans and identifiers meet.
CELL = 64
#: Rounds of scores before sure identifiers become known.
ROUNDS = 3
#: Different known identifiers that a pattern has to have met, and the share of its instances that has to be known.
SUPPORT = 3
CONFIDENCE = 0.8
LEAST_LENGTH = 5


def base_spans(text: Column) -> Column:
    """E-mail addresses, IPv4 addresses, card and phone numbers of a text, by kind and start."""
    email = located(text, EMAIL, "email", F.contains(text, F.lit("@")))
    ip = located(text, IP, "ip", F.rlike(text, F.lit(r"[0-9]\.[0-9]")))
    card = located(text, CARD, "card", F.rlike(text, F.lit("[0-9](?:[ -]?[0-9]){15}")))
    phone = located(text, PHONE, "phone", F.contains(text, F.lit("+")))

    def small(part: Column) -> Column:
        bare = F.regexp_replace(part, "^0+", "")
        return (F.length(bare) <= 3) & (F.when(bare == "", 0).otherwise(F.substring(bare, 1, 3).cast("int")) <= 255)

    ip = F.filter(ip, lambda s: F.forall(F.split(s["value"], r"\."), small))
    card = F.filter(card, lambda s: F.length(digits(s["value"])).between(16, 19) & passes_luhn(digits(s["value"])))
    phone = F.filter(phone, lambda s: F.length(digits(s["value"])).between(8, 15))
    return F.concat(email, ip, card, phone)


def _bare(word: Column) -> Column:
    """A word without punctuation at its ends, lower case."""
    return F.lower(F.regexp_replace(word, r"^[^\p{L}\p{N}@+]+|[^\p{L}\p{N}]+$", ""))


def _found(docs: DataFrame) -> DataFrame:
    """One row per document, without its text: base spans, and identifiers with their contexts."""
    text = F.col("text")
    words = located(text, IDENTIFIER, "context", F.rlike(text, F.lit("[0-9@]")), context=True)

    def described(s: Column) -> Column:
        first = F.length(s["before"]) == s["start"]
        before = F.concat(F.when(first, f"{START} ").otherwise(""), F.lower(s["before"]))
        last = (F.length(s["after"]) < CONTEXT) & F.rlike(s["after"], F.lit(r"^\s*$"))
        return F.struct(
            s["start"].alias("start"), s["end"].alias("end"), _bare(s["value"]).alias("instance"),
            F.regexp_extract(before, LEFT, 1).alias("left"), F.regexp_extract(before, LAST, 1).alias("last"),
            F.when(last, END).otherwise(F.lower(F.regexp_extract(s["after"], RIGHT, 1))).alias("right"))

    return docs.select("doc_id", "key", "check", base_spans(text).alias("base"), F.transform(words, described).alias("words"))


def seeded(rows: DataFrame) -> DataFrame:
    """All identifiers, a row each, with ``seed``: whether a base span touches it. Both meet in the cells of the text they lie in."""
    cell = F.explode(F.sequence(F.floor(F.col("start") / CELL), F.floor((F.col("end") - 1) / CELL)))
    words = rows.select("key", "check", F.explode("words").alias("w")).select("key", "check", "w.*").distinct()
    base = rows.select("key", "check", F.explode("base").alias("b")).select("key", "check", "b.start", "b.end").distinct()
    base = base.withColumn("cell", cell).withColumnsRenamed({"start": "from", "end": "to"})
    touched = words.select("key", "check", "start", "end").withColumn("cell", cell).join(base, ["key", "check", "cell"]).filter(
        "start < to and `from` < `end`").select("key", "check", "start", F.lit(True).alias("touched")).distinct()
    return words.join(touched, ["key", "check", "start"], "left").withColumn("seed", F.col("touched").isNotNull()).drop("touched")


def patterns(occurrences: DataFrame) -> DataFrame:
    """Edges between contexts and identifiers with the contexts' confidence after the last round.

    A context is two words before, or one before and one after; the start and the end of a text count as words. It is as sure as the share of its
    instances that are known, an instance as sure as its best context; seeds stay sure. Identifiers that
    became sure are known from then on and support contexts like seeds, until no context becomes sure. A context that a third of
    all rows share is only summed and joined, and sums are combined before the shuffle.
    """
    contexts = F.array_compact(F.array(
        F.when(F.col("left") != "", F.concat_ws(" ", "left", F.lit("_"))),
        F.when((F.col("last") != "") & (F.col("right") != ""), F.concat_ws(" ", "last", F.lit("_"), "right"))))
    edges = stored(
        occurrences.withColumn("pattern", F.explode(contexts))
        .groupBy("pattern", "instance").agg(F.max(F.col("seed").cast("int")).alias("seed")).withColumn("known", F.col("seed")))
    sure = 0
    while True:
        scored = _scored(edges)
        before, sure = sure, scored.filter(F.col("trust") >= CONFIDENCE).count()
        if sure <= before:
            return scored
        found = (F.col("sure") >= CONFIDENCE) & (F.length("instance") >= LEAST_LENGTH)
        following = stored(scored.select("pattern", "instance", "seed", F.greatest("known", found.cast("int")).alias("known")))
        dropped(edges)
        dropped(scored)
        edges = following


def _scored(edges: DataFrame) -> DataFrame:
    """``edges`` with the confidence of contexts and identifiers after ``ROUNDS`` rounds from what is known."""
    scored = edges.withColumn("sure", F.col("known").cast("double"))
    for n in range(ROUNDS):
        trust = scored.groupBy("pattern").agg(
            (F.sum("sure") / F.count(F.lit(1))).alias("trust"), F.sum("known").alias("support"))
        trust = trust.withColumn("trust", F.when(F.col("support") >= SUPPORT, F.col("trust")).otherwise(0.0))
        linked = edges.join(trust, "pattern")
        best = linked.groupBy("instance").agg(F.greatest(F.max("trust"), F.max("known").cast("double")).alias("sure"))
        last, scored = scored, stored(linked.join(best, "instance").select("pattern", "instance", "seed", "known", "trust", "sure"))
        if n:
            dropped(last)
    return scored


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``key``, ``check`` and ``spans`` of every row of ``docs``: base spans by kind, then found identifiers.

    Seeds are the words that base spans touch. Their contexts become patterns, patterns and identifiers are scored in turn,
    and other identifiers of at least ``LEAST_LENGTH`` characters in a context surer than ``CONFIDENCE`` are spans
    of kind ``context``. Null texts count as empty and have no spans. Every row gives one row; rows
    that are equal have equal spans. Other columns are ignored, an empty table gives an empty result.
    """
    rows = stored(_found(keyed(docs, id_col, text_col)))
    seen = stored(seeded(rows))
    scored = patterns(seen)
    unseen = scored.filter((F.col("seed") == 0) & (F.col("trust") >= CONFIDENCE) & (F.length("instance") >= LEAST_LENGTH)) \
        .select("instance").distinct()
    added = (
        seen.filter(~F.col("seed")).join(unseen, "instance")
        .groupBy("key", "check").agg(F.sort_array(F.collect_set(F.struct(
            F.lit("context").alias("kind"), "start", "end", F.col("instance").alias("value")))).alias("added"))
    )
    spans = F.concat("base", F.coalesce("added", F.array().cast(f"array<{SPAN}>")))
    return rows.join(added, ["key", "check"], "left").select("doc_id", "key", "check", spans.alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """Counts, the hash of the base spans and all spans as text, per document."""
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS))
    counts = [count_of(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span of personal data in its text replaced by its kind in angle brackets.

    Spans that touch one another become one mark, named after the first. Null texts stay null; other columns stay.
    """
    found = stored(find(docs, id_col, text_col).filter(F.size("spans") > 0).dropDuplicates(["key", "check"])).select(
        F.col("key").alias("_key"), F.col("check").alias("_check"), F.col("spans").alias("_spans"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed_docs = docs.withColumns({"_key": F.xxhash64(F.col(id_col).cast("long"), text), "_check": F.hash(text)})
    maybe, others = parted(keyed_docs, found, "_key")
    marked = maybe.join(found, ["_key", "_check"], "left")
    by_start = F.array_sort(F.transform("_spans", lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def step(state: Column, s: Column) -> Column:
        fresh = s["start"] >= state["at"]
        between = F.substring(F.col(text_col), state["at"] + 1, s["start"] - state["at"])
        return F.struct(
            F.greatest(state["at"], s["end"]).alias("at"),
            F.when(fresh, F.concat(state["text"], between, F.lit("<"), s["kind"], F.lit(">"))).otherwise(
                state["text"]).alias("text"))

    whole = F.aggregate(
        by_start, F.struct(F.lit(0).alias("at"), F.lit("").alias("text")), step,
        lambda state: F.concat(state["text"], F.substring(F.col(text_col), state["at"] + 1, F.lit(2**31 - 1))))
    clean = F.when(F.col("_spans").isNull(), F.col(text_col)).otherwise(whole)
    return others.select(*docs.columns).union(marked.withColumn(text_col, clean).select(*docs.columns))
