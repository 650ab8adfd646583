import datetime
import random

import pytest

from stallwise.operators import maintenance

START = datetime.datetime(2025, 1, 1)


def rows():
    r = random.Random(3)
    out = [("hot", START + datetime.timedelta(minutes=7 * i), i, r.choice([1, 1, 1, 2, None])) for i in range(400)]
    out += [("hot", START + datetime.timedelta(days=9, minutes=400 * i), 1000 + i, 5) for i in range(30)]
    return out + [(k, START + datetime.timedelta(hours=r.randrange(100)), 2000 + i, 1) for i, k in enumerate(["a", "b", None] * 8)]


@pytest.mark.parametrize("per_slice", [100_000, 50])
def test_changes(spark, per_slice):
    data = {(k, at): v for k, at, _, v in rows() if k}
    frame = spark.createDataFrame([(k, at, v) for (k, at), v in data.items()], "k string, at timestamp, v int")
    want, last = set(), {}
    for (k, at), v in sorted(data.items(), key=lambda x: x[0]):
        if k not in last or last[k] != v:
            want.add((k, at, v))
        last[k] = v
    assert {tuple(r) for r in maintenance.changes_in_time(frame, "k", "at", "v", per_slice).collect()} == want
    assert maintenance.changes_in_time(frame.limit(0), "k", "at", "v").count() == 0


@pytest.mark.parametrize("per_slice", [100_000, 50])
def test_sessions(spark, per_slice):
    frame = spark.createDataFrame([(k, at, tie) for k, at, tie, _ in rows()], "k string, at timestamp, tie long")
    want, last, number = {}, {}, {}
    for k, at, _, _ in sorted(rows(), key=lambda x: (str(x[0]), x[1], x[2])):
        if k not in last or at - last[k] > datetime.timedelta(hours=6):
            number[k] = number.get(k, 0) + 1
            want[k, number[k]] = [0, at, at]
        want[k, number[k]][0] += 1
        want[k, number[k]][2] = last[k] = at
    got = {(r.k, r.session): [r.events, r.opened, r.closed] for r in maintenance.sessions(frame, "k", "at", "tie", 6 * 3600 * 1_000_000, per_slice).collect()}
    assert got == want
