"""Ranking: pages, caps per group, nearest values, newest rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int = 1, place: str = "place") -> DataFrame:
    """The first ``n`` rows of each group; ``order`` should end with a unique key. The limit also applies before the shuffle."""
    return df.withColumn(place, F.row_number().over(W.partitionBy(*group).orderBy(*order)).cast("long")).filter(F.col(place) <= n)


def page_of(df: DataFrame, order: Sequence[Column], page: int, size: int = 48) -> DataFrame:
    """One page, counted from 1; a page before the first or beyond the last becomes the first or last."""
    pages = max(1, -(-df.count() // size))
    page = min(max(page, 1), pages)
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def capped(df: DataFrame, group: str, seed: str, key: str, per_group: int, total: int) -> DataFrame:
    """At most ``per_group`` rows of a group and ``total`` in all, in an order that the seed shuffles.

    Equals a greedy walk along the shuffled rows: a row is taken unless its group is full, until ``total`` are taken.
    """
    shuffle = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    chosen = top_per_group(df.withColumn("shuffle", shuffle), [group], [F.col("shuffle"), F.col(key)], per_group, "in_group")
    return chosen.orderBy("shuffle", key).limit(total).drop("in_group")


def nearest_values(df: DataFrame, group: str, key: str, value: str, n: int) -> DataFrame:
    """``key``, ``neighbour``, ``gap`` and ``place`` of the n rows of the group whose value is nearest.

    Rows are ordered by value and key; only the n before and after a row can be nearest, so no pairs are built beyond
    those. On equal gaps the fewer rows between go first, then the one before.
    """
    w = W.partitionBy(group).orderBy(value, key)
    around = [F.struct(*[f(c, i).over(w).alias(a) for c, a in ((key, "neighbour"), (value, "other"))], F.lit(2 * i + s).alias("near")) for i in range(1, n + 1) for s, f in ((0, F.lag), (1, F.lead))]
    pairs = df.select(group, key, value, F.array(*around).alias("around")).select(group, key, value, F.explode("around").alias("o")).filter("o.neighbour IS NOT NULL")
    gaps = pairs.select(group, key, F.col("o.neighbour").alias("neighbour"), F.abs(F.col(value) - F.col("o.other")).alias("gap"), F.col("o.near").alias("near"))
    return top_per_group(gaps, [group, key], [F.col("gap"), F.col("near")], n).drop("near")


def sorted_values(values: Column) -> Column:
    """Distinct values: by number, without a needless .0, if all are numbers, else as text."""
    numbers = F.transform(values, lambda v: v.try_cast("double"))
    plain = F.transform(F.array_sort(numbers), lambda v: F.when(v == F.floor(v), F.floor(v).cast("string")).otherwise(v.cast("string")))
    return F.when(F.exists(numbers, lambda v: v.isNull()), F.array_sort(values)).otherwise(plain)
