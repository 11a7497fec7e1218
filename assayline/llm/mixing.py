"""Mixing sources to target weights: repetition rates per source, floor(rate) copies plus one hash-seeded Bernoulli copy.

Sizes are counted once and written down (three narrow columns); everything else
works on that table and on one row per source.  No task sees a whole source: totals
combine on the map side and a copy is decided row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayline.llm.common import WORD, pin, shielded

#: Seeds tried per source; the one whose extra copies come nearest to the target is used.
SEEDS = 32
#: Sources up to which their table is broadcast.
BROADCAST_SOURCES = 100_000


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _draw(seed: Column) -> Column:
    """A number in [0, 1) fixed by the document (id, content, its number among equal ones) and the seed."""
    h = F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1)), F.col("size"), F.col("content"), F.col("number"), seed)
    return F.shiftrightunsigned(h, 11).cast("double") / float(1 << 53)


def targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """(source, source_size) with ``target``: shares of the total by weight, at most ``cap`` times the size, excess reshared.

    Sources take the weights in turn, by code point, null last.  Each round fixes the
    sources at or above their limit and shares the rest anew; sums of whole numbers
    make it exact.  Rounds end when none is above, at the latest after one round per
    distinct size; in practice after a few.
    """
    spark = sources.sparkSession
    ranked = sources.orderBy(F.col("source").isNull(), F.col("source")).rdd.zipWithIndex().map(lambda x: (*x[0], x[1]))
    table = spark.createDataFrame(ranked, "source string, source_size long, place long")
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    table = pin(table.select("source", "source_size", turn.cast("long").alias("weight"), (F.col("source_size") * cap).alias("most")))
    total = table.agg(F.sum("source_size")).first()[0] or 0
    left, open_weight, above = total, None, F.lit(False)
    while True:
        row = table.agg(F.sum(F.when(above, F.col("most"))).alias("fixed"), F.sum(F.when(~above, F.col("weight"))).alias("open")).first()
        left, before, open_weight = total - int(row["fixed"] or 0), open_weight, int(row["open"] or 0)
        if open_weight == before or open_weight == 0:
            break
        above = F.col("most").cast("decimal(38,0)") * open_weight < F.col("weight").cast("decimal(38,0)") * left
    share = F.col("weight") * F.lit(float(left)) / F.lit(float(max(open_weight, 1)))
    return table.select("source", "source_size", F.when(above, F.col("most").cast("double")).otherwise(share).alias("target"))


def source_rates(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """One row per source: source, source_size, target, whole (copies of every document), part (chance of one more), seed.

    ``docs`` has doc_id, source, size, content (a hash) and number.
    """
    sources = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    rates = targets(sources, weights, cap).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    rates = _sized(pin(rates.withColumn("whole", F.floor("rate")).withColumn("part", F.col("rate") - F.floor("rate")).drop("rate")))
    extra = [F.sum(F.when(_draw(F.lit(s)) < F.col("part"), F.col("size")).otherwise(0)).alias(f"s{s}") for s in range(SEEDS)]
    off = F.array(*[F.struct(F.abs(F.col(f"s{s}") - F.col("want")).alias("off"), F.lit(s).alias("seed")) for s in range(SEEDS)])
    drawn = _with(docs, rates).groupBy("source").agg((F.first("part") * F.first("source_size")).alias("want"), *extra)
    return _sized(pin(_with(rates, drawn.select("source", F.array_min(off)["seed"].alias("seed")))))


def _sized(per_source: DataFrame) -> DataFrame:
    """The table of sources, to be broadcast if it has at most ``BROADCAST_SOURCES`` rows (some ten megabytes); else joined by shuffle."""
    return F.broadcast(per_source) if per_source.count() <= BROADCAST_SOURCES else per_source


def _with(rows: DataFrame, per_source: DataFrame) -> DataFrame:
    """A join on source that takes null as a source; ``per_source`` is broadcast if it was counted and is small."""
    right = per_source.withColumnRenamed("source", "_source")
    return rows.join(right, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def _copies() -> Column:
    return (F.col("whole") + (_draw(F.col("seed")) < F.col("part")).cast("long")).cast("long")


def plan_mix(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, doc_id: str = "doc_id", text: str = "text", source: str = "source"
) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, copies and taken (= copies * size).

    rate = target / source_size; a document is taken floor(rate) times, and once more
    if its draw, hashed from id, size and seed, is below the fraction.  Of ``SEEDS``
    seeds a source uses the one that comes nearest to its target (ties: the smallest).

    Null text: size 0, and size 0 takes no words.  Null source is a source of its own,
    last in order.  Rows that share an id draw by their text, and equal rows by their
    number: they are counted and numbered from 1, so each has a draw of its own.  Only the
    three named columns are read; no documents give no rows.
    """
    sized = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).alias("source"), words_in(F.col(text)).alias("size"), F.xxhash64(F.col(text)).alias("content"))
    equal = sized.groupBy("doc_id", "source", "size", "content").agg(F.count(F.lit(1)).alias("n"))
    rows = pin(equal.select("doc_id", "source", "size", "content", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("number")))
    mixed = _with(rows, source_rates(rows, weights, cap)).withColumn("copies", _copies())
    return mixed.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """The documents of the mix: every column of ``docs`` (doc_id, text and source among them) and ``copy``, one row per copy.

    Decisions and edge cases as in :func:`plan_mix`, but that rows with the same id and text share
    a draw: to number them, texts would have to be shuffled.  Texts meet only the table of
    sources, so they stay where they are while that table is small enough to broadcast.
    """
    docs, restore = shielded(docs, ("doc_id", "text", "source"))
    sized = docs.withColumns({"size": words_in(F.col("text")), "content": F.xxhash64("text"), "number": F.lit(1).cast("long")})
    rows = pin(sized.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "size", "content", "number"))
    copies = F.when(F.col("_copies") > 0, F.sequence(F.lit(1), F.col("_copies").cast("int")))
    out = _with(sized, source_rates(rows, weights, cap)).withColumn("_copies", _copies())
    return restore(out.select(*docs.columns, F.explode(copies).alias("copy")))
