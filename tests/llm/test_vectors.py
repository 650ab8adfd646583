import numpy as np
import pandas as pd
import pytest

from stallwise.llm import vectors


def collection(n, dims, copies=0, dense=0, seed=1):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(n // 4, dims))
    x = np.concatenate([c + 0.35 * r.normal(size=(4, dims)) for c in centres])
    if copies:
        x = np.concatenate([x, np.repeat(x[:1], copies, axis=0)])
    if dense:
        x = np.concatenate([x, centres[0] + 0.3 * r.normal(size=(dense, dims))])
    return (x * r.uniform(0.5, 2, size=(len(x), 1))).astype(np.float32) if not copies else x.astype(np.float32)


def brute(x, k=5, least=0.8):
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    np.fill_diagonal(s, -2)
    return {(i, int(j)) for i in range(len(x)) for j in np.lexsort((np.arange(len(x)), -s[i]))[:k] if s[i, j] >= least}


def found(spark, x, dims, extra=()):
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + list(extra)
    df = spark.createDataFrame(rows, "id long, embedding array<float>").selectExpr("id", "embedding", "id AS bucket", "id AS a")
    return {(r.id, r.neighbour) for r in vectors.most_similar(df, dims=dims).collect()}


def test_recall_against_brute_force(spark):
    x = collection(400, 32, copies=30)
    want = brute(x)
    nan, inf = float("nan"), float("inf")
    bad = [(900, None), (901, [0.0] * 32), (902, [1.0] * 31), (903, [nan] + [1.0] * 31), (904, [inf] + [1.0] * 31), (None, [1.0] * 32), (905, [None] + [1.0] * 31), (3, x[3].tolist())]
    got = found(spark, x, 32, bad)
    assert got <= {p for p in got if max(p) < 900}
    assert len(got & want) / len(want) >= 0.95 and got <= want | got
    copies = [400 + i for i in range(30)]
    assert {(c, n) for c, n in got if c in copies} == {(c, n) for c, n in want if c in copies}  # copies are exact


def test_crowded_buckets_are_hashed_again(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BUCKET", 40)
    x = collection(200, 16, dense=150, seed=4)
    want = brute(x)
    assert len(found(spark, x, 16) & want) / len(want) >= 0.9


def test_empty(spark):
    assert vectors.most_similar(spark.createDataFrame([], "id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("k", [8, 12])
def test_probe_sets_are_valid_and_in_order(k):
    sets = vectors.probe_sets(k, 20)
    assert len(set(sets)) == 20 and sets[0] == (0,)
    assert all(2 * k - 1 - i not in s for s in sets for i in s)


def test_bitmap_agrees_with_the_database_functions(spark):
    from pyspark.sql import functions as F

    bits = [0, 1, 32767, 32768, 32769, 65536, 2**25 - 1]
    df = spark.createDataFrame([(b,) for b in bits], "bit long")
    bitmap = vectors._existing(df.select(F.col("bit")))
    probe = np.array([*bits, 2, 5000, 32770, 2**25 - 2])
    assert vectors._held(bitmap, probe).tolist() == [True] * len(bits) + [False] * 4


def test_crowds_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BUCKET", 15)
    monkeypatch.setattr(vectors, "BLOCK", 500, raising=False)
    r = np.random.default_rng(11)
    far, near = r.normal(size=(300, 32)), r.normal(size=(1, 32)) + 0.23 * r.normal(size=(1200, 32))  # most at a cosine of about 0.95
    x = np.concatenate([far, near]).astype(np.float32)
    want = brute(x)
    assert len(found(spark, x, 32) & want) / len(want) >= 0.995


@pytest.mark.parametrize("k", [15, 19, 22])
def test_chance_of_meeting_is_the_same_at_any_size(k):
    tables = getattr(vectors, "tables_for", lambda _: vectors.TABLES)(k)
    r = np.random.default_rng(5)
    x, other = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in r.normal(size=(2, 600, 64)))
    other -= (other * x).sum(axis=1, keepdims=True) * x
    y = 0.8 * x + 0.6 * other / np.linalg.norm(other, axis=1, keepdims=True)
    (own_x, probed_x), (own_y, probed_y) = (vectors.hash_keys(v, k, tables, vectors.PROBES) for v in (x, y))
    met = (own_x == own_y) | (probed_x == own_y[:, :, None]).any(axis=2) | (probed_y == own_x[:, :, None]).any(axis=2)
    assert met.any(axis=1).mean() >= 0.95


def test_all_but_equal_vectors_are_exact(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BUCKET", 40)
    monkeypatch.setattr(vectors, "BLOCK", 100, raising=False)
    r = np.random.default_rng(8)
    x = (r.normal(size=(1, 32)) + 3e-4 * r.normal(size=(300, 32))).astype(np.float32)
    assert found(spark, x, 32) == brute(x)


def test_scaled_copies_are_copies(spark):
    v = np.random.default_rng(9).normal(size=32).astype(np.float32)
    df = spark.createDataFrame([(i, (v * np.float32(s)).tolist()) for i, s in enumerate([1, 2, 0.25, -1])], "id long, embedding array<float>")
    hashes = {r.id: (r.h1, r.h2) for r in vectors._members(df, 32).collect()}
    assert hashes[0] == hashes[1] == hashes[2] != hashes[3]


def test_a_dense_cluster_of_thousands_loses_nothing(spark):
    r = np.random.default_rng(12)
    x = (r.normal(size=(1, 48)) + 1e-2 * r.normal(size=(8000, 48))).astype(np.float32)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    df = spark.createDataFrame(pd.DataFrame({"id": range(len(x)), "embedding": list(map(list, x.tolist()))}), "id long, embedding array<float>")
    got = {}
    for row in vectors.most_similar(df, dims=48).filter("id % 20 = 0").collect():
        got.setdefault(row.id, set()).add(row.neighbour)
    similar = np.round(unit[::20] @ unit.T, 9)
    hits = 0
    for i, values in zip(range(0, len(x), 20), similar):
        values[i] = -2
        fifth = np.sort(values)[-5]
        hits += sum(values[n] >= fifth for n in got[i])
    assert hits / (5 * len(similar)) >= 0.999


@pytest.mark.parametrize("least, limit", [(0.8, 40), (0.6, 54), (1.0, 0)])
def test_the_sketch_limit_follows_the_least_cosine(least, limit):
    assert vectors.sketch_limit(least) == limit


def test_the_bitmap_grows_with_the_buckets_within_bounds():
    assert [vectors.bitmap_bits(n) for n in (0, 10**6, 10**7, 10**12)] == [25, 25, 27, 29]
