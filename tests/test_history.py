import datetime
import random

import pytest
from pyspark.sql import functions as F

from stallwise.operators.history import attribute_history, satellites

SCHEMA = "snap_id long, listing_id long, price_kes decimal(12,2), in_stock boolean, last_checked_at timestamp, loaded_at timestamp, entity string"
GROUPS = {"price": ["price_kes"], "stock": ["in_stock"]}
DAY = datetime.datetime(2025, 1, 1)


def brute(rows):
    best = {}
    for snap, listing, price, stock, at, loaded, _ in rows:
        if at is None or listing is None:
            continue
        order = (loaded is not None, loaded or DAY, snap)
        if (listing, at) not in best or order >= best[listing, at][0]:
            best[listing, at] = (order, price, stock)
    out, by = [], {}
    for (listing, at), (_, price, stock) in sorted(best.items(), key=lambda x: (x[0][0], x[0][1])):
        last = by.get(listing)
        if last is None:
            by[listing] = [price, stock]
            out.append([listing, at, None])
        else:
            now = [last[0] if price is None else price, last[1] if stock is None else stock]
            if now != last:
                out.append([listing, at, None])
            by[listing] = now
    for a, b in zip(out, out[1:]):
        if a[0] == b[0]:
            a[2] = b[1]
    us = lambda t: int((t - datetime.datetime(1970, 1, 1)).total_seconds() * 1_000_000)
    return sorted((listing, us(a), us(b) if b else -1) for listing, a, b in out)


def rows(n, seed):
    r = random.Random(seed)
    out = []
    for snap in range(n):
        price = r.choice([None, 10, 10, 20, 30])
        out.append((snap, r.choice([None, 1, 1, 1, 2, 3]), price and __import__("decimal").Decimal(price), r.choice([None, True, True, False]), r.choice([None] + [DAY + datetime.timedelta(hours=r.randrange(40))] * 9), r.choice([None, DAY, DAY + datetime.timedelta(days=3)]), "x"))
    return out + out[: n // 5]


@pytest.mark.parametrize("per_slice", [100_000, 7])
def test_equals_a_plain_walk(spark, per_slice):
    data = rows(160, per_slice)
    df = spark.createDataFrame(data, SCHEMA)
    got = attribute_history(df, "listing_id", "last_checked_at", "loaded_at", "snap_id", GROUPS, per_slice)
    assert sorted(map(tuple, got.select("listing_id", "valid_from_us", "valid_to_us").collect())) == brute(data)


def test_empty_and_satellites(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert attribute_history(empty, "listing_id", "last_checked_at", "loaded_at", "snap_id", GROUPS).count() == 0
    data = spark.createDataFrame([(1, 1, None, True, DAY, DAY, "")], SCHEMA).withColumn("price_kes", F.lit(5).cast("decimal(12,2)"))
    stored = satellites(data, "listing_id", "last_checked_at", "loaded_at", "snap_id", GROUPS)
    assert sorted(r.satellite for r in stored.rows.collect()) == ["price", "stock"]
