"""Cutting hot keys into ordered slices, so that no task has to hold a whole hot group."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import durable

#: Rows of one key that a task may hold; keys with more are cut into slices of about this size.
ROWS_PER_SLICE = 250_000


class Sliced(NamedTuple):
    """Rows with ``slice_no`` (0, 1, ... along a key's rows) and ``slice_of`` (1 for ordinary keys)."""

    rows: DataFrame
    split: bool  #: whether any key has more than one slice


def with_slices(df: DataFrame, key: str, position: str, rows_per_slice: int = ROWS_PER_SLICE) -> Sliced:
    """``df`` with its hot keys cut into slices along ``position``, a BIGINT column; equal positions stay together.

    The counts are combined map-side before the shuffle and written once: there is at most one hot key for every
    ``rows_per_slice`` rows. Slices end at quantiles of a key's positions, so they are even in rows, wherever these bunch.
    The cuts are joined without a hint, so the adaptive planner broadcasts them only below its size limit. Without a hot
    key, the usual case, nothing is joined and the rows are not written. Null keys form one key.
    """
    hot = durable(
        df.groupBy(F.col(key).alias("hot_key"))
        .agg(F.count(F.lit(1)).alias("hot_rows"))
        .filter(F.col("hot_rows") > rows_per_slice)
        .withColumn("hot_slices", F.ceil(F.col("hot_rows") / F.lit(rows_per_slice)).cast("int"))
    )
    most = hot.agg(F.max("hot_slices")).first()[0]
    if most is None:
        return Sliced(df.withColumns({"slice_no": F.lit(0), "slice_of": F.lit(1)}), False)
    same = F.col(key).eqNullSafe(F.col("hot_key"))
    quantiles = F.percentile_approx(position, [i / most for i in range(1, most)], max(10_000, 20 * most))
    ends = F.expr("transform(sequence(1, hot_slices - 1), i -> hot_quantiles[cast(floor(i * (size(hot_quantiles) + 1) / hot_slices) as int) - 1])")
    cuts = durable(df.join(hot, same).groupBy("hot_key", "hot_slices").agg(quantiles.alias("hot_quantiles")).select("hot_key", F.array_distinct(ends).alias("hot_cuts")))
    number = F.size(F.filter("hot_cuts", lambda cut: cut < F.col(position)))
    rows = (
        df.join(cuts, same, "left")
        .withColumns({"slice_no": F.when(F.col("hot_cuts").isNull(), 0).otherwise(number), "slice_of": F.when(F.col("hot_cuts").isNull(), 1).otherwise(F.size("hot_cuts") + 1)})
        .drop("hot_key", "hot_cuts")
    )
    return Sliced(durable(rows), True)


def micros(ts: Column) -> Column:
    """Microseconds since 1970-01-01 UTC."""
    return F.unix_micros(ts)


def with_halo(sliced: Sliced, key: str, position: str, rows: int) -> DataFrame:
    """The slices with up to ``rows`` neighbouring rows of the slices before and after; ``own`` marks a slice's own rows.

    A window over (key, slice_no) then sees its neighbourhood across the cuts. A neighbour slice with fewer rows gives
    fewer. Without hot keys every row is its slice's own and nothing is copied.
    """
    if not sliced.split:
        return sliced.rows.withColumn("own", F.lit(True))
    order = W.partitionBy(key, "slice_no").orderBy(position)
    ranked = (
        sliced.rows.filter(F.col("slice_of") > 1)
        .withColumns({"from_start": F.row_number().over(order), "slice_rows": F.count(F.lit(1)).over(W.partitionBy(key, "slice_no"))})
    )
    lent = [
        ranked.filter(F.col("from_start") <= rows).withColumn("slice_no", F.col("slice_no") - 1),
        ranked.filter(F.col("from_start") > F.col("slice_rows") - rows).withColumn("slice_no", F.col("slice_no") + 1),
    ]
    copies = lent[0].unionByName(lent[1]).filter(F.col("slice_no").between(0, F.col("slice_of") - 1)).drop("from_start", "slice_rows")
    return sliced.rows.withColumn("own", F.lit(True)).unionByName(copies.withColumn("own", F.lit(False)))
