"""Attribute history from repeated snapshots: insert-only satellites and views that close their periods.

A satellite holds one group of attributes that change at a similar rate. It is only ever appended to: a row goes in
when the hash of the group's values (the hash-diff) differs from the row before. No end date is stored; the view
computes it from the next row's start, so late rows never force an update of what is stored.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .skew import ROWS_PER_SLICE, Sliced, micros, with_slices


def latest_readings(df: DataFrame, key: str, at: str, loaded: str, tie: str, attributes: Sequence[str]) -> DataFrame:
    """One row per (key, at): of several, the one with the latest ``loaded``, then the largest ``tie``.

    Rows without ``at`` or key are left out; a null ``loaded`` counts as the earliest. Columns: key, ``at_us``
    (microseconds) and the attributes. Aggregates map-side; a hot key is spread, as ``at`` is part of the grouping.
    """
    values = F.struct(*[F.col(a).alias(a) for a in attributes])
    order = F.struct(F.col(loaded).isNotNull(), F.col(loaded), F.col(tie))
    return (
        df.filter(F.col(at).isNotNull() & F.col(key).isNotNull())
        .groupBy(F.col(key), micros(F.col(at)).alias("at_us"))
        .agg(F.max_by(values, order).alias("kept"))
        .select(key, "at_us", *[F.col("kept")[a].alias(a) for a in attributes])
    )


def filled(sliced: Sliced, key: str, attributes: Sequence[str]) -> DataFrame:
    """Nulls replaced by the key's last known value, with ``before_*`` (the values a row earlier) and ``first``.

    Each slice is filled by itself; what was known at the end of the slices before comes from one summary row a
    slice, made for hot keys only.
    """
    within = W.partitionBy(key, "slice_no").orderBy("at_us")
    so_far = within.rowsBetween(W.unboundedPreceding, 0)
    local = sliced.rows.select(
        key,
        "slice_no",
        "slice_of",
        "at_us",
        *[F.last(a, ignorenulls=True).over(so_far).alias(a) for a in attributes],
        F.row_number().over(within).alias("nth"),
    )
    start = F.col("nth") == 1
    if not sliced.split:
        return local.withColumns({f"before_{a}": F.lag(a).over(within) for a in attributes} | {"first": start}).drop("nth")
    ends = (
        sliced.rows.filter(F.col("slice_of") > 1)
        .groupBy(key, "slice_no")
        .agg(*[F.max_by(a, F.when(F.col(a).isNotNull(), F.col("at_us"))).alias(f"end_{a}") for a in attributes])
    )
    earlier = W.partitionBy(key).orderBy("slice_no").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select(
        key,
        "slice_no",
        (F.count(F.lit(1)).over(earlier) > 0).alias("continues"),
        *[F.last(f"end_{a}", ignorenulls=True).over(earlier).alias(f"carried_{a}") for a in attributes],
    )
    return (
        local.join(carried, [key, "slice_no"], "left")
        .withColumns({a: F.coalesce(a, f"carried_{a}") for a in attributes})
        .withColumns({f"before_{a}": F.when(start, F.col(f"carried_{a}")).otherwise(F.lag(a).over(within)) for a in attributes})
        .withColumn("first", start & ~F.coalesce("continues", F.lit(False)))
        .drop("nth", "continues", *[f"carried_{a}" for a in attributes])
    )


def hash_diff(columns: Sequence[Column]) -> Column:
    """A hash of the values in which a null differs from every value."""
    return F.xxhash64(*[x for c in columns for x in (c.isNull(), c)])


def satellites(
    df: DataFrame,
    key: str,
    at: str,
    loaded: str,
    tie: str,
    groups: Mapping[str, Sequence[str]],
    rows_per_slice: int = ROWS_PER_SLICE,
) -> Sliced:
    """The satellites' rows together: key, slice columns, ``satellite``, ``at_us``, ``hash_diff`` and the attributes.

    ``groups`` maps a satellite's name to its attributes; those of the other satellites are null in its rows. A row
    exists for a key's first reading and wherever the hash-diff changes. A null reading keeps the previous value;
    before the first known value, null is the value. Repeated rows change nothing; columns of other names, whatever
    they are called, are ignored; an empty table gives no rows.
    """
    attributes = [a for group in groups.values() for a in group]
    named = df.select(
        F.col(key).alias("entity"), F.col(at).alias("read_at"), F.col(loaded).alias("loaded"), F.col(tie).alias("tie"), *attributes
    )
    readings = latest_readings(named, "entity", "read_at", "loaded", "tie", attributes)
    sliced = with_slices(readings, "entity", "at_us", rows_per_slice)
    rows = filled(sliced, "entity", attributes)
    entries = []
    for name, own in groups.items():
        now, then = hash_diff([F.col(a) for a in own]), hash_diff([F.col(f"before_{a}") for a in own])
        values = [(F.col(a) if a in own else F.lit(None)).alias(a) for a in attributes]
        entries.append(F.when(F.col("first") | (now != then), F.struct(F.lit(name).alias("satellite"), now.alias("hash_diff"), *values)))
    changed = F.filter(F.array(*entries), lambda r: r.isNotNull())
    entry = rows.select(F.col("entity").alias(key), "slice_no", "slice_of", "at_us", F.explode(changed).alias("entry"))
    return Sliced(entry.select(key, "slice_no", "slice_of", "at_us", "entry.*"), sliced.split)


def history_view(stored: Sliced, key: str, attributes: Sequence[str]) -> DataFrame:
    """Versions over all satellites: key, ``valid_from_us``, ``valid_to_us`` (-1 while it holds) and the attributes.

    A version starts where any satellite has a row and ends where the next one starts.
    """
    known = [F.first(a, ignorenulls=True).alias(a) for a in attributes]
    starts = stored.rows.groupBy(key, "slice_no", "slice_of", "at_us").agg(*known)
    following = F.lead("at_us").over(W.partitionBy(key, "slice_no").orderBy("at_us"))
    versions = filled(Sliced(starts, stored.split), key, attributes).withColumn("next_us", following)
    if stored.split:
        opens = starts.filter(F.col("slice_of") > 1).groupBy(key, "slice_no").agg(F.min("at_us").alias("opens"))
        later = opens.select(key, "slice_no", F.lead("opens").over(W.partitionBy(key).orderBy("slice_no")).alias("later_us"))
        versions = versions.join(later, [key, "slice_no"], "left").withColumn("next_us", F.coalesce("next_us", "later_us"))
    return versions.select(key, F.col("at_us").alias("valid_from_us"), F.coalesce("next_us", F.lit(-1)).alias("valid_to_us"), *attributes)


def attribute_history(
    df: DataFrame,
    key: str,
    at: str,
    loaded: str,
    tie: str,
    groups: Mapping[str, Sequence[str]],
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Satellites and their view in one step."""
    attributes = [a for group in groups.values() for a in group]
    return history_view(satellites(df, key, at, loaded, tie, groups, rows_per_slice), key, attributes)
