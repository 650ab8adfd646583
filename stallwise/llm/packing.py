"""Items packed into containers of a fixed capacity with little unused room.

Items longer than the capacity are cut into full containers and a rest; nothing else is split. Rests and shorter items
are packed in windows by minimum bin slack: the longest item left opens a container, and a bitset of reachable sums over
the lengths left finds the multiset that fills the remaining room best; the counts come from walking the bitsets back.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.sizes import broadcast_below
from ..session import durable

WINDOW = 20_000  #: items packed together in one task; more windows, not larger ones, for more items
MAX_KINDS = 1_000


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, taken from ``counts``, whose sum comes closest to ``room`` without exceeding it.

    Longer lengths go first, so that short items are kept for later rooms; the search ends once the room can be filled.
    """
    lengths = sorted((n for n in counts if 0 < n <= room and counts[n] > 0), reverse=True)
    mask, full = (1 << (room + 1)) - 1, 1 << room
    reach, steps = 1, []
    for length in lengths:
        left = min(counts[length], room // length)
        steps.append((length, left, reach))
        size = 1
        while left > 0:  # the count in powers of two and a rest reaches every number of items up to it
            take = min(size, left)
            reach |= (reach << (length * take)) & mask
            left -= take
            size *= 2
        if reach & full:
            break
    at, chosen = reach.bit_length() - 1, {}
    for length, most, before in reversed(steps):
        k = next(k for k in range(most + 1) if at - k * length >= 0 and before >> (at - k * length) & 1)
        if k:
            chosen[length] = k
            at -= k * length
    return chosen


def pack(lengths: list[int], capacity: int) -> list[int]:
    """The container number, from 0, of each item. Items of length 0 go to the first; longer ones must not occur."""
    counts: dict[int, int] = {}
    for n in lengths:
        if n > 0:
            counts[n] = counts.get(n, 0) + 1
    plan: dict[int, list[int]] = {n: [] for n in counts}
    container = 0
    while counts:
        longest = max(counts)
        chosen = {longest: 1}
        counts[longest] -= 1
        for n, k in fill(counts, capacity - longest).items():
            chosen[n] = chosen.get(n, 0) + k
            counts[n] -= k
        for n, k in chosen.items():
            plan[n] += [container] * k
            if not counts[n]:
                del counts[n]
        container += 1
    queues = {n: iter(c) for n, c in plan.items()}
    return [next(queues[n]) if n > 0 else 0 for n in lengths]


def packed(items: DataFrame, limits: DataFrame, window: int = WINDOW) -> DataFrame:
    """Every item in containers of every kind: ``container_kind``, ``container``, ``doc_id``, ``piece_no``, ``tokens``.

    ``items`` has doc_id and n_tokens; ``limits`` has container_kind and capacity_tokens and is small. Pieces of an item
    are numbered in text order; all but the last fill a container. Items without tokens take no room and share their
    window's first container. Repeated rows are items of their own. Kinds without a positive capacity are left out.
    """
    kinds = limits.filter("container_kind IS NOT NULL AND capacity_tokens > 0").select("container_kind", F.col("capacity_tokens").cast("long").alias("capacity"))
    numbered = durable(items.select("doc_id", F.coalesce(F.col("n_tokens"), F.lit(0)).cast("long").alias("n_tokens")))
    rows = numbered.count()
    # The rows are written, so their numbers stay the same when a task is repeated.
    numbered = numbered.withColumn("row", F.monotonically_increasing_id())
    windows = max(1, -(-rows // window))
    each = numbered.crossJoin(broadcast_below(kinds, MAX_KINDS))  # one copy of an item for every kind, of which there are few
    whole = F.when(F.col("n_tokens") > F.col("capacity"), F.ceil(F.col("n_tokens") / F.col("capacity")) - 1).otherwise(F.lit(0)).cast("long")
    each = each.withColumn("full", whole)
    cut = each.filter("full > 0").select(
        "container_kind",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)).alias("piece_no"),
        F.col("row"),
        "doc_id",
        F.col("capacity").alias("tokens"),
    )
    cut = cut.select("container_kind", F.concat_ws("-", F.lit("full"), F.col("row").cast("string"), F.col("piece_no").cast("string")).alias("container"), "doc_id", "piece_no", "tokens")
    rests = each.select(
        "container_kind",
        "capacity",
        "doc_id",
        F.col("full").alias("piece_no"),
        (F.col("n_tokens") - F.col("full") * F.col("capacity")).alias("tokens"),
        F.pmod(F.xxhash64("row"), F.lit(windows)).cast("long").alias("window"),
        "row",
    )

    def pack_window(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["tokens", "row"], ascending=[False, True], kind="stable")
        containers = pack([int(n) for n in rows["tokens"]], int(rows["capacity"].iloc[0]))
        names = np.array([f"w{key[1]}-{c}" for c in containers], dtype=object)
        return rows.assign(container=names)[["container_kind", "container", "doc_id", "piece_no", "tokens"]]

    schema = "container_kind string, container string, doc_id long, piece_no long, tokens long"
    return cut.unionByName(rests.groupBy("container_kind", "window").applyInPandas(pack_window, schema))


def container_report(containers: DataFrame, limits: DataFrame) -> DataFrame:
    """For every kind: containers, tokens, and the share of their room that stays unused."""
    used = containers.groupBy("container_kind", "container").agg(F.sum("tokens").alias("tokens"))
    kinds = limits.select("container_kind", F.col("capacity_tokens").alias("capacity"))
    return (
        used.groupBy("container_kind")
        .agg(F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"))
        .join(kinds, "container_kind")
        .select("container_kind", "containers", "tokens", (1 - F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("unused_share"))
    )
