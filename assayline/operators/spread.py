"""Building blocks that stay spread out when one key owns most of the rows.

Spark already splits skewed *joins* (AQE) and combines *aggregates* on the map
side.  Window functions are what is left: ``partitionBy(key)`` sends a whole key
to one task.  The helpers here cut a key into bounded segments first and stitch
the segments together through a much smaller table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayline.session import checkpoint_dir

DEFAULT_SALTS = 64
#: Rows of a key that are ordered in one task; a key with more is cut into ranges.
ROWS_PER_RANGE = 1_000_000
#: A table of large keys of up to so many rows is broadcast.
BROADCAST_KEYS = 100_000


def evaluate_once(df: DataFrame, keep: list[str | Column], **computed: Column) -> DataFrame:
    """``keep`` plus ``computed`` columns that are evaluated exactly once per row.

    The optimizer copies a projected expression into every filter and projection
    that uses it; for a parsed document or sixty path patterns that multiplies
    the cost.  A one-element generator is a boundary it does not move them across.  Its
    argument is a column of the projection below: a generator's own expressions are interpreted,
    a projection's are compiled and share their common parts.
    """
    fields = F.struct(*[col.alias(name) for name, col in computed.items()])
    kept = [F.col(k) if isinstance(k, str) else k for k in keep]
    rows = df.select(*kept, fields.alias("_computed"))
    return rows.select(*[F.col(f"`{c}`") for c in rows.columns[:-1]], F.inline(F.array("_computed")))


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt out over all tasks by ``keys``, for operators whose rows cost far more to work on than to move.

    Else a file of few row groups, or one with long documents, leaves most tasks idle.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def sized(df: DataFrame) -> DataFrame:
    """``df`` written down beside the checkpoints, so that the size check of a join sees what it really is.

    The planner guesses an aggregate to be as large as its input and shuffles both sides of a join with it.
    """
    spark = df.sparkSession
    name = f"{checkpoint_dir(spark)}/sized-{uuid.uuid4().hex}"
    df.write.parquet(name)
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(name)


def top_n(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    n: int,
    spread: Column | None = None,
    salts: int = DEFAULT_SALTS,
) -> DataFrame:
    """The first ``n`` rows per key, in two rounds.

    Round one keeps ``n`` rows per (key, salt); round two sees at most
    ``n * salts`` rows of a key.  ``order`` must be total for a stable answer.
    """
    salt = F.pmod(F.xxhash64(spread) if spread is not None else F.xxhash64(*df.columns), F.lit(salts))
    first = Window.partitionBy(*keys, "_salt").orderBy(*order)
    last = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_salt", salt)
        .withColumn("_rn", F.row_number().over(first))
        .where(F.col("_rn") <= n)
        .drop("_salt")
        .withColumn("_rn", F.row_number().over(last))
        .where(F.col("_rn") <= n)
        .drop("_rn")
    )


def in_ranges(df: DataFrame, keys: list[str], order: list[str], rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Add ``_seg``, which does not decrease along ``order`` and cuts each key into runs of about ``rows_per_range`` rows.

    Keys are counted first; all rows of an ordinary key are segment 0.  Rows of larger keys
    are dealt out by ranges of (key, order), whose bounds Spark samples, and written
    down with the number of their range, so every later pass sees the same cut.  A range
    is cut between different values of ``order`` only: rows that tie in it stay together.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows_per_range)
    checkpoint_dir(df.sparkSession)
    large = sizes.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_n").checkpoint()
    found = large.agg(F.count(F.lit(1)).alias("keys"), F.sum("_n").alias("rows")).first()
    if not found["keys"]:
        return df.withColumn("_seg", F.lit(0))
    large = F.broadcast(large.drop("_n")) if found["keys"] <= BROADCAST_KEYS else large.drop("_n")
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    ranges = max(2, -(-found["rows"] // rows_per_range))
    dealt = df.join(large, same, "left_semi").repartitionByRange(ranges, *keys, *order).withColumn("_seg", F.spark_partition_id()).checkpoint()
    return df.join(large, same, "left_anti").withColumn("_seg", F.lit(0)).unionByName(dealt)


def _cut(df: DataFrame, keys: list[str], order: list[str], segment: Column | None, rows_per_range: int) -> DataFrame:
    """``df`` with ``_seg``: the caller's segment, or ranges of bounded size."""
    return in_ranges(df, keys, order, rows_per_range) if segment is None else df.withColumn("_seg", segment)


def previous_value(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    value: str,
    segment: Column | None,
    out: str,
    last: str = "_prev_last",
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """``lag(value)`` per key by ``order`` without one task per key.

    ``segment`` must not decrease along ``order`` (for a timestamp: its day); without one,
    large keys are cut by :func:`in_ranges`.  Each (key, segment) is ordered on its own;
    only one row per segment, its last value, goes through the window over the whole key.
    """
    inner = Window.partitionBy(*keys, "_seg").orderBy(*order)
    df = _cut(df, keys, order, segment, rows_per_range)
    rows = df.withColumn("_rn", F.row_number().over(inner)).withColumn("_in", F.lag(value).over(inner))
    tails = df.groupBy(*keys, "_seg").agg(F.max_by(F.col(value), F.struct(*order)).alias(last))
    across = Window.partitionBy(*keys).orderBy("_seg")
    carried = tails.select(*keys, "_seg", F.lag(last).over(across).alias(last)).where(F.col(last).isNotNull())
    joined = rows.join(carried, [*keys, "_seg"], "left")
    return joined.withColumn(out, F.when(F.col("_rn") == 1, F.col(last)).otherwise(F.col("_in"))).drop(
        "_seg", "_rn", "_in", last
    )


def carry_forward(
    df: DataFrame, keys: list[str], order: list[str], value: str, segment: Column | None, out: str, rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """Last non-null ``value`` up to and including each row, segment by segment; without ``segment`` in ranges of bounded size."""
    inner = Window.partitionBy(*keys, "_seg").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    df = _cut(df, keys, order, segment, rows_per_range)
    rows = df.withColumn("_in", F.last(value, ignorenulls=True).over(inner))
    tails = (
        df.groupBy(*keys, "_seg")
        .agg(F.max_by(F.col(value), F.when(F.col(value).isNotNull(), F.struct(*order))).alias("_tail"))
    )
    across = Window.partitionBy(*keys).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.select(*keys, "_seg", F.last("_tail", ignorenulls=True).over(across).alias("_tail")).where(
        F.col("_tail").isNotNull()
    )
    return (
        rows.join(carried, [*keys, "_seg"], "left")
        .withColumn(out, F.coalesce("_in", "_tail"))
        .drop("_seg", "_in", "_tail")
    )


def positions(
    df: DataFrame, keys: list[str], order: list[str], segment: Column | None = None, out: str = "pos", rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """0-based position of each row in its key plus the key's row count (``n_rows``).

    Counts per segment are summed in a window over segments, so the only window
    over a whole key is over one row per segment.
    """
    seg = _cut(df, keys, order, segment, rows_per_range)
    inner = Window.partitionBy(*keys, "_seg").orderBy(*order)
    counts = seg.groupBy(*keys, "_seg").agg(F.count(F.lit(1)).alias("_n"))
    by_seg = Window.partitionBy(*keys).orderBy("_seg")
    offsets = counts.select(
        *keys,
        "_seg",
        (F.sum("_n").over(by_seg) - F.col("_n")).alias("_before"),
        F.sum("_n").over(Window.partitionBy(*keys)).alias("n_rows"),
    )
    return (
        seg.withColumn("_rn", F.row_number().over(inner))
        .join(offsets, [*keys, "_seg"])
        .withColumn(out, F.col("_before") + F.col("_rn") - 1)
        .drop("_seg", "_rn", "_before")
    )


def stride_sample(
    df: DataFrame, keys: list[str], order: list[str], cap: int, segment: Column | None = None, rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """Evenly spaced ``cap`` rows per key when it has more, all rows otherwise.

    Row ``p`` of ``n`` is kept when some ``i < cap`` has ``floor(i * n / cap) = p``;
    the only candidate is ``i = ceil(p * cap / n)``, so no join with an index list is needed.
    """
    ranked = positions(df, keys, order, segment, "_p", rows_per_range)
    i = F.expr(f"(_p * {cap} + n_rows - 1) div n_rows")
    hit = (i < cap) & (F.expr(f"(((_p * {cap} + n_rows - 1) div n_rows) * n_rows) div {cap}") == F.col("_p"))
    return ranked.where((F.col("n_rows") <= cap) | hit).drop("_p", "n_rows")


def chunked(df: DataFrame, key: str, row_id: Column, per_chunk: int) -> DataFrame:
    """Add ``chunk``: an even split of each key into pieces of about ``per_chunk`` rows.

    The number of chunks follows the key's size, so a document built per chunk stays
    bounded whatever the skew, and no row is left out.  The chunk comes from a
    content hash that any engine can repeat.  Sizes are written down first: one row per key seldom needs
    the rows themselves to be shuffled for the join.
    """
    sizes = sized(df.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / per_chunk).cast("bigint").alias("_n")))
    place = F.conv(F.substring(F.sha2(row_id, 256), 1, 8), 16, 10).cast("bigint")
    return df.join(sizes, key).withColumn("chunk", F.pmod(place, F.col("_n"))).drop("_n")


def running_total(
    df: DataFrame, keys: list[str], order: str, value: str, out: str, width: int | None = None, rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """Running sum of ``value`` per key along a numeric ``order``, in blocks of ``width`` positions or else in ranges of bounded size."""
    seg = _cut(df, keys, [order], None if width is None else F.floor(F.col(order) / width), rows_per_range)
    inner = Window.partitionBy(*keys, "_seg").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    sums = seg.groupBy(*keys, "_seg").agg(F.sum(value).alias("_s"))
    across = Window.partitionBy(*keys).orderBy("_seg")
    before = sums.select(*keys, "_seg", (F.sum("_s").over(across) - F.col("_s")).alias("_before"))
    return (
        seg.withColumn("_in", F.sum(value).over(inner))
        .join(before, [*keys, "_seg"])
        .withColumn(out, F.col("_in") + F.col("_before"))
        .drop("_seg", "_in", "_before")
    )
