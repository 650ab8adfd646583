import datetime
import random

import pytest

from stallwise.operators.spikes import impossible_readings

SCHEMA = "snap_id long, listing_id long, merchant_id long, price_kes double, in_stock boolean, last_checked_at timestamp, loaded_at timestamp, source string, y int"
DAY = datetime.datetime(2025, 1, 1)


def series(listing, merchant, prices, stock=True, first=0):
    return [(first + i, listing, merchant, p, stock, DAY + datetime.timedelta(days=i), DAY + datetime.timedelta(days=i, hours=1), "s", 1) for i, p in enumerate(prices)]


def data():
    r = random.Random(5)
    rows, snap = [], 0
    for listing in range(1, 21):  # a merchant that hardly moves its prices
        rows += series(listing, 1, [1000.0] * 30, first=snap)
        snap += 100
    for listing in range(21, 41):  # one that always does, by about a tenth
        rows += series(listing, 2, [1000 * (1 + r.uniform(-0.1, 0.1)) for _ in range(40)], first=snap)
        snap += 100
    return rows


def changed(rows, listing, at, price):
    return [(*r[:3], price, *r[4:]) if r[1] == listing and (r[5] - DAY).days in at else r for r in rows]


@pytest.mark.parametrize("per_slice", [100_000, 25])
def test_kinds_of_fault(spark, per_slice):
    rows = data()
    wrong = [(1, [10], 10_000.0), (2, [10, 11], 600.0), (3, [5], -1.0), (4, [29], 12_345_678.0), (22, [7], 4_000.0)]
    right = [(5, [10, 11, 12, 13, 14], 800.0), (6, list(range(15, 30)), 1_400.0), (23, [7], 1_150.0)]
    for listing, at, price in wrong + right:
        rows = changed(rows, listing, at, price)
    rows = changed(rows, 30, list(range(10, 25)), 1_010.0)  # frozen where prices always move
    expected = {r[0] for r in rows for listing, at, _ in wrong if r[1] == listing and (r[5] - DAY).days in at}
    expected |= {r[0] for r in rows if r[1] == 30 and 11 <= (r[5] - DAY).days <= 24}
    frame = spark.createDataFrame(rows + rows[:50], SCHEMA)
    got = [r.snap_id for r in impossible_readings(frame, per_slice).collect()]
    assert len(got) == len(set(got)) and set(got) == expected


def test_nulls_and_empty(spark):
    assert impossible_readings(spark.createDataFrame([], SCHEMA)).count() == 0
    odd = [(1, None, None, -5.0, None, None, None, None, None), (2, 1, None, None, None, DAY, None, None, None), (3, 1, None, 5.0, None, None, None, None, None)]
    assert [r.snap_id for r in impossible_readings(spark.createDataFrame(odd, SCHEMA)).collect()] == [1]


def test_rounds_go_on_until_nothing_is_found(spark):
    rows, at = [], {8: 7.03, 18: 1.86, 28: 1.225}  # each kind hides the next in the merchant's quantiles
    for listing in range(1, 31):
        rows += series(listing, 1, [1000.0 * at.get(i, 1.0) for i in range(40)], first=100 * listing)
    got = {r.snap_id for r in impossible_readings(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {100 * listing + i for listing in range(1, 31) for i in at}
