"""Upkeep of a catalogue: merging, re-keying, sweeping and forwarding, as set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import durable
from .ranking import top_per_group
from .skew import ROWS_PER_SLICE, micros, with_halo, with_slices


def orphans(parents: DataFrame, key: str, children: DataFrame, reference: str) -> DataFrame:
    """Parents that no child refers to."""
    return parents.join(children.select(F.col(reference).alias(key)).filter(F.col(key).isNotNull()), key, "left_anti")


def keep_latest(df: DataFrame, group: Sequence[str], at: str, key: str) -> DataFrame:
    """The newest row of each group, of equally new ones the one with the largest key."""
    return top_per_group(df, group, [F.col(at).desc_nulls_last(), F.col(key).desc()]).drop("place")


def winners(df: DataFrame, group: str, key: str, order: Sequence[Column]) -> DataFrame:
    """``key`` and ``winner``: the key that the others of its group are merged into."""
    best = top_per_group(df, [group], [*order, F.col(key)]).select(group, F.col(key).alias("winner"))
    return df.select(group, key).join(best, group).select(key, "winner")


def compressed_redirects(redirects: DataFrame, old: str = "old", new: str = "new") -> DataFrame:
    """Forwardings that lead straight to their last target; chains halve in each round, targets in a cycle drop out."""
    state = durable(redirects.filter(F.col(old) != F.col(new)).groupBy(old).agg(F.min(new).alias(new)))
    for _ in range(64):
        onward = state.select(F.col(old).alias(new), F.col(new).alias("onward"))
        stepped = state.join(onward, new, "left").select(old, F.coalesce("onward", new).alias(new), F.col("onward").isNotNull().alias("moved"))
        stepped = durable(stepped.filter(F.col(old) != F.col(new)))
        if stepped.filter("moved").isEmpty():
            return stepped.select(old, new)
        state = stepped.drop("moved")
    return stepped.filter("NOT moved").select(old, new)


def rekey_plan(current: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """What a recomputed key asks for: ``action`` keep, move (the key exists), create or leave (no new key)."""
    existing = current.select(F.col(old).alias(new)).filter(F.col(new).isNotNull()).distinct().withColumn("exists", F.lit(True))
    action = (
        F.when(F.col(new).isNull(), "leave").when(F.col(new).eqNullSafe(F.col(old)), "keep").when(F.col("exists"), "move").otherwise("create")
    )
    return current.join(existing, new, "left").select(key, old, new, action.alias("action"))


def merged_offers(current: DataFrame, incoming: DataFrame, keys: Sequence[str], order: str, overwrite: Sequence[str], fill: Sequence[str] = ()) -> DataFrame:
    """The state after an upsert: of a key's incoming rows the last one overwrites, ``fill`` columns only where null.

    A full outer join on the keys; both sides are first reduced to a row a key.
    """
    last = top_per_group(incoming, keys, [F.col(order).desc()]).drop("place")
    columns = [*overwrite, *fill]
    joined = current.select(*keys, *[F.col(c).alias(f"old_{c}") for c in columns], F.lit(True).alias("was")).join(last.select(*keys, *columns, F.lit(True).alias("came")), list(keys), "full_outer")
    values = [F.when(F.col("came"), F.col(c)).otherwise(F.col(f"old_{c}")).alias(c) for c in overwrite]
    values += [F.coalesce(F.when(F.col("was"), F.col(f"old_{c}")), F.col(c)).alias(c) for c in fill]
    status = F.when(F.col("came").isNull(), "kept").when(F.col("was").isNull(), "new").otherwise("updated")
    return joined.select(*keys, *values, status.alias("status"))


def inserted_if_absent(current: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The incoming rows whose key is not there yet, each key once."""
    return incoming.dropDuplicates(list(keys)).join(current.select(*keys), list(keys), "left_anti")


def changes_only(readings: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, stored: DataFrame | None = None) -> DataFrame:
    """The readings whose value differs from the one before along the order, starting from a stored value if there is one."""
    before = F.lag(value).over(W.partitionBy(*keys).orderBy(*order))
    if stored is not None:
        readings = readings.join(stored.select(*keys, F.col(value).alias("stored_value")), list(keys), "left")
        before = F.coalesce(before, F.col("stored_value"))
    return readings.withColumn("before", before).filter(~F.col("before").eqNullSafe(F.col(value))).drop("before", "stored_value")


def changes_in_time(readings: DataFrame, key: str, at: str, value: str, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """The readings whose value differs from the one before in time, a key's first one included.

    ``readings`` has one row a key and time. A hot key is cut into slices of its time; each sees the last row of the slice
    before, so nothing changes at the cuts.
    """
    cut = with_halo(with_slices(readings.withColumn("at_us", micros(F.col(at))), key, "at_us", rows_per_slice), key, "at_us", 1)
    order = W.partitionBy(key, "slice_no").orderBy("at_us")
    compared = cut.withColumns({"before": F.lag(value).over(order), "first": F.row_number().over(order) == 1})
    return compared.filter(F.col("own") & (F.col("first") | ~F.col("before").eqNullSafe(F.col(value)))).select(*readings.columns)


def sessions(events: DataFrame, key: str, at: str, tie: str, gap_us: int, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """``key``, ``session`` (1, 2, ... in time), ``events``, ``opened`` and ``closed``: a key's events cut by longer gaps.

    A hot key is cut into slices of its time. A slice numbers its own sessions; how many the slices before hold is added
    afterwards from one summary row a slice, and a session that crosses a cut is put together from its parts.
    """
    cut = with_halo(with_slices(events.select(key, at, tie, micros(F.col(at)).alias("at_us")), key, "at_us", rows_per_slice), key, "at_us", 1)
    order = W.partitionBy(key, "slice_no").orderBy("at_us", tie)
    gap = F.col("at_us") - F.lag("at_us").over(order) > gap_us
    opens = cut.withColumn("opens", F.coalesce(gap, F.lit(True)).cast("long")).filter("own")
    local = opens.withColumn("nth", F.sum("opens").over(order.rowsBetween(W.unboundedPreceding, 0)))
    parts = local.groupBy(key, "slice_no", "nth").agg(F.count(F.lit(1)).alias("events"), F.min(at).alias("opened"), F.max(at).alias("closed"), F.max("opens").alias("fresh"))
    numbered = parts.withColumn("session", F.sum("fresh").over(W.partitionBy(key).orderBy("slice_no", "nth")))
    return numbered.groupBy(key, "session").agg(F.sum("events").alias("events"), F.min("opened").alias("opened"), F.max("closed").alias("closed"))
