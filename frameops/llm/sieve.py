"""Find the rows of a large table whose id is in another table, without shuffling the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from frameops.llm.store import stored

#: 2**25 bits make 1,024 bitmaps of 4 KiB: the broadcast is 4 MiB at most, whatever the tables hold.
BITS = 25


def _marked(facts: DataFrame, ids: DataFrame, id_col: str, name: str) -> DataFrame:
    """``facts`` with a column ``name``: whether ``id_col`` may be in ``ids``; a null is not."""
    bit = F.pmod(F.xxhash64(id_col), F.lit(1 << BITS))
    placed = {"_word": F.shiftright(bit, 15), "_bit": bit.bitwiseAND(F.lit(32767))}
    maps = (
        ids.select(id_col).filter(F.col(id_col).isNotNull()).withColumns(placed)
        .groupBy("_word").agg(F.expr("bitmap_construct_agg(_bit)").alias("_map"))
    )
    byte = F.expr("cast(conv(hex(substring(_map, cast(_bit div 8 as int) + 1, 1)), 16, 10) as int)")
    # proven bound: 2**BITS bits
    marked = facts.withColumns(placed).join(F.broadcast(maps), "_word", "left").withColumn("_byte", byte)
    hit = F.coalesce(F.expr("shiftright(_byte, cast(_bit % 8 as int)) % 2 = 1"), F.lit(False)) & F.col(id_col).isNotNull()
    return marked.select(*facts.columns, hit.alias(name))


def parted(facts: DataFrame, ids: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows of ``facts`` whose ``id_col`` may be in ``ids``, and rows whose isn't; a null is not.

    A bitmap of hashed ids of fixed size goes to every executor and tells them apart where they are read. With
    more ids than bits only the saving shrinks.
    """
    marked = _marked(facts, ids, id_col, "_hit")
    return marked.filter("_hit").select(*facts.columns), marked.filter("not _hit").select(*facts.columns)


def told(facts: DataFrame, wanted: DataFrame, id_col: str, name: str) -> DataFrame:
    """``facts`` with a column ``name``: whether ``id_col`` is in ``wanted``, whose ids are distinct; null matches nothing.

    A second bitmap holds the bits that an id of ``facts`` outside ``wanted`` shares with one inside. Where it is not set
    the first one is exact; only rows at those bits are read again and joined, none if there are no such ids.
    """
    maybe, _ = parted(facts.select(id_col), wanted, id_col)
    strays = stored(maybe.join(wanted, id_col, "left_anti").distinct())
    marked = _marked(facts, wanted, id_col, name)
    if strays.isEmpty():
        return marked
    doubtful = _marked(marked, strays, id_col, "_doubtful")
    known = wanted.select(id_col, F.lit(True).alias("_known"))
    settled = doubtful.filter("_doubtful").join(known, id_col, "left").withColumn(name, F.col("_known").isNotNull())
    return doubtful.filter("not _doubtful").select(*marked.columns).union(settled.select(*marked.columns))


def sieved(facts: DataFrame, wanted: DataFrame, id_col: str) -> DataFrame:
    """Rows of ``facts`` whose ``id_col`` is in ``wanted``; null matches nothing."""
    maybe, _ = parted(facts, wanted, id_col)
    # not a semi-join: the optimiser would move that below the bitmaps and shuffle all rows
    return maybe.join(wanted.select(id_col).distinct(), id_col).select(*facts.columns)


def left_out(facts: DataFrame, unwanted: DataFrame, id_col: str) -> DataFrame:
    """Rows of ``facts`` whose ``id_col`` is not in ``unwanted``; rows without an id stay."""
    maybe, others = parted(facts, unwanted, id_col)
    marked = unwanted.select(id_col).distinct().withColumn("_gone", F.lit(True))
    return others.union(maybe.join(marked, id_col, "left").filter("_gone is null").select(*facts.columns))
