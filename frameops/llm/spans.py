"""Places of pattern matches in texts, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Start and end are code points, counted from 0, the end exclusive.
SPAN = "struct<kind:string,start:int,end:int,value:string>"


#: Matches whose places are summed up in one go; the work for n matches grows with n times this, not with n squared.
RUN = 256
#: Characters of the text around a match that are kept if asked for.
CONTEXT = 120


def located(text: Column, pattern: str, kind: str, needs: Column, context: bool = False) -> Column:
    """All leftmost matches of ``pattern`` as an array of spans; texts without ``needs`` are not searched.

    The parts between matches and the matches give the places: a running sum of their lengths, over runs of matches.
    With ``context`` a span also has the text before and after it.
    """
    kinds = SPAN[:-1] + ",before:string,after:string>" if context else SPAN
    empty = F.array().cast(f"array<{kinds}>")
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.split(text, pattern, -1)
    zipped = F.arrays_zip(parts.alias("before"), values.alias("value"), F.slice(parts, 2, 2**30).alias("after"),
                          F.slice(values, 2, 2**30).alias("next")) if context else F.arrays_zip(
        parts.alias("before"), values.alias("value"))

    def length(pair: Column) -> Column:
        return F.length(pair["before"]) + F.length(F.coalesce(pair["value"], F.lit("")))

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["before"])
        end = start + F.length(pair["value"])
        fields = [F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), pair["value"].alias("value")]
        rest = []
        if context:
            before = F.right(F.concat(state["tail"], pair["before"]), F.lit(CONTEXT))
            after = F.left(F.concat(F.left(pair["after"], F.lit(CONTEXT)), F.coalesce(pair["next"], F.lit(""))), F.lit(CONTEXT))
            fields += [before.alias("before"), after.alias("after")]
            rest = [F.right(F.concat(before, pair["value"]), F.lit(CONTEXT)).alias("tail")]
        return F.struct(end.alias("at"), F.array_append(state["spans"], F.struct(*fields)).alias("spans"), *rest)

    def spans(pairs: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / RUN).cast("int")),
                           lambda r: F.slice(pairs, r * RUN + 1, F.lit(RUN)))

        # what goes from run to run: the place, and with context the last characters of the text before
        def summed(state: Column, run: Column) -> Column:
            size = F.aggregate(run, F.lit(0), lambda n, pair: n + length(pair))
            held = [state["at"].alias("at"), *([state["tail"].alias("tail")] if context else [])]
            return F.struct((state["at"] + size).alias("at"), *([ending(run).alias("tail")] if context else []), F.array_append(
                state["runs"], F.struct(*held, run.alias("run"))).alias("runs"))

        def ending(run: Column) -> Column:
            # a match has a character at least; only a whole run is followed by another
            last = F.transform(F.slice(run, RUN - CONTEXT + 1, F.lit(CONTEXT)), lambda pair: F.concat(
                F.right(pair["before"], F.lit(CONTEXT)), F.coalesce(pair["value"], F.lit(""))))
            return F.right(F.array_join(last, ""), F.lit(CONTEXT))

        tail = [F.lit("").alias("tail")] if context else []
        start = F.struct(F.lit(0).alias("at"), *tail, F.filter(F.transform(F.slice(runs, 1, 1), lambda r: F.struct(
            F.lit(0).alias("at"), *tail, r.alias("run"))), lambda _: F.lit(False)).alias("runs"))
        placed = F.aggregate(runs, start, summed, lambda state: state["runs"])
        return F.flatten(F.transform(placed, lambda r: F.aggregate(
            F.filter(r["run"], lambda pair: pair["value"].isNotNull()),
            F.struct(r["at"].alias("at"), empty.alias("spans"), *([r["tail"].alias("tail")] if context else [])), step, lambda state: state["spans"])))

    # bound to a variable, the pairs are made once and not for every run
    found = F.element_at(F.transform(F.array(zipped), spans), 1)
    return F.when(needs & F.rlike(text, F.lit(pattern)), found).otherwise(empty)


def written(spans: Column) -> Column:
    """Spans as text, ``kind:start:end`` joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(kind: str) -> Column:
    """How many of the column ``spans`` are of a kind."""
    return F.size(F.filter("spans", lambda s: s["kind"] == kind))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id``, ``text`` (null as empty) and a key of 96 bits that rows share only if both are equal."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    doc_id = F.col(id_col).cast("long")
    return docs.select(
        doc_id.alias("doc_id"), text.alias("text"), F.xxhash64(doc_id, text).alias("key"), F.hash(text).alias("check"))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def passes_luhn(number: Column) -> Column:
    """Whether a string of digits has a valid check digit."""
    from_right = F.split(F.reverse(number), "")
    worth = F.transform(
        F.filter(from_right, lambda d: d != ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
            F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)))
    return F.aggregate(worth, F.lit(0), lambda a, d: a + d) % 10 == 0
