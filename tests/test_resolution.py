import time

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from stallwise.operators import resolution
from stallwise.plans import matching
from stallwise.session import ensure_checkpoint_dir
from stallwise.sources.tables import stored


def test_match_or_create(spark):
    products = spark.createDataFrame([(1, "a|x", "a-x"), (2, "a|x", "a-x-2"), (3, None, None)], "id long, key string, slug string")
    offers = [(1, "a|x", "t"), (2, "b|y", None), (3, "b|y", "b-y"), (4, "c|z", "a-x"), (5, "d|q", "b-y"), (6, None, "n"), (7, "e|r", None), (8, "c|z", "a-x")]
    got = {r.seq: (r.status, r.product_id, r.new_slug) for r in resolution.match_or_create(spark.createDataFrame(offers, "seq long, key string, slug string"), products).collect()}
    assert got == {
        1: ("matched", 1, None), 2: ("created", None, "b-y"), 3: ("joined", None, "b-y"), 4: ("rejected", None, None), 5: ("rejected", None, None),
        6: ("unparsed", None, None), 7: ("created", None, None), 8: ("rejected", None, None),
    }
    assert resolution.match_or_create(spark.createDataFrame([], "seq long, key string, slug string"), products).count() == 0


@pytest.mark.parametrize(
    "similarity, key, specs, other_key, other_specs, decision",
    [
        (0.96, "a|x-1", "{}", "a|x1", "{}", "merge"),
        (0.96, "a|x", "{}", "a|z", "{}", "queue"),
        (0.95, "a|x", None, "a|x", None, "merge"),
        (0.92, "a|x", "{}", "a|x", "{}", "queue"),
        (0.89, "a|x", "{}", "a|x", "{}", "none"),
        (0.99, "a|x", '{"ram_gb": 8}', "a|x", '{"ram_gb": "6"}', "none"),
        (0.99, "a|128gb", "{}", "a|256gb", "{}", "none"),
        (0.99, None, None, None, None, "queue"),
        (None, "a|x", "{}", "a|x", "{}", "none"),
    ],
)
def test_bands_and_guards(spark, similarity, key, specs, other_key, other_specs, decision):
    df = spark.createDataFrame([(similarity, key, specs, other_key, other_specs)], "s double, k string, p string, l string, q string")
    assert df.select(resolution.merge_decision(*[F.col(c) for c in "skplq"]).alias("d")).first().d == decision


@pytest.mark.parametrize("key, fallback, chosen", [("a|b", "a|b|c", "a|b|c"), ("a|b|c", "a|b", "a|b|c"), ("a|b", "x|y", "a|b"), (None, "a", "a"), ("a", None, "a"), (None, None, None)])
def test_the_deeper_key_wins(spark, key, fallback, chosen):
    assert spark.createDataFrame([(key, fallback)], "k string, f string").select(resolution.deeper_key(F.col("k"), F.col("f")).alias("d")).first().d == chosen


def test_offers_of_merged_products(spark):
    offers = [(1, 10, 5), (2, 11, 5), (3, 11, 6), (4, 12, 6), (5, 12, 7), (6, 13, 5), (7, None, 5), (8, 10, 5)]
    winners = spark.createDataFrame([(10, 10), (11, 10), (12, 10)], "product_id long, winner long")
    got = {r.id: (r.product_id, r.action) for r in resolution.moved_offers(spark.createDataFrame(offers, "id long, product_id long, merchant_id long"), winners).collect()}
    assert got == {1: (10, "kept"), 2: (None, "dropped"), 3: (10, "moved"), 4: (None, "dropped"), 5: (10, "moved"), 6: (13, "kept"), 7: (None, "kept"), 8: (10, "kept")}


def test_unit_vectors(spark):
    rows = [([3.0, 4.0],), ([0.0, 0.0],), ([float("nan"), 1.0],), ([float("inf"), 1.0],), ([],), (None,)]
    got = [r.u for r in spark.createDataFrame(rows, "v array<float>").select(resolution.unit_vector(F.col("v")).alias("u")).collect()]
    assert got[0] == pytest.approx([0.6, 0.8]) and got[1:] == [None] * 5


def test_a_long_vector_is_brought_to_length_one_in_one_pass(spark):
    long = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(60_000)), lambda i: (i % 7).cast("float")).alias("v"))
    began = time.time()
    assert long.select(F.aggregate(resolution.unit_vector(F.col("v")), F.lit(0.0), lambda s, v: s + v * v).alias("n")).first().n == pytest.approx(1)
    assert time.time() - began < 30


def nearest(ids, vectors, asked):
    """Brute force, with every sum added up in order and rounded as SQL does it: id -> (other, similarity)."""
    x = np.asarray(vectors, dtype=float)
    units = x / np.sqrt(np.cumsum(x * x, axis=1)[:, -1])[:, None]
    found = {}
    for i in np.flatnonzero(asked):
        dots = np.cumsum(units[i] * units, axis=1)[:, -1] * 10_000
        rounded = np.copysign(np.floor(np.abs(dots)) + (np.abs(dots) - np.floor(np.abs(dots)) >= 0.5), dots)
        found[ids[i]] = max(((r / 10_000, -o) for r, o in zip(rounded.tolist(), ids) if o != ids[i]), default=None)
    return {i: (-b[1], b[0]) for i, b in found.items() if b}


def test_merge_candidates_of_many_products_end_soon(spark, tmp_path):
    n, rng = 12_000, np.random.default_rng(3)
    x = rng.normal(size=(n, 384)).astype(np.float32)
    x[6_000:] = x[:6_000] + rng.normal(size=(6_000, 384)).astype(np.float32) * 0.2
    offsets = pa.array(np.arange(0, n * 384 + 1, 384, dtype=np.int32))
    columns = {"id": list(range(n)), "category_slug": ["a"] * n, "canonical_key": ["k"] * n, "specs": ["{}"] * n, "embedding": pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))}
    pq.write_table(pa.table(columns), tmp_path / "product.parquet", row_group_size=2_000)
    began = time.time()
    got = {r.id: (r.other, r.similarity) for r in matching.merge_candidates(spark, str(tmp_path)).collect()}
    assert time.time() - began < 40
    some = np.zeros(n, dtype=bool)
    some[::400] = True
    assert len(got) == 600 and nearest(range(n), x, some).items() <= got.items()


def test_the_queue_of_many_products_ends_soon_and_is_as_in_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    n, rng = 8_000, np.random.default_rng(11)
    x = np.repeat(rng.normal(size=(n // 4, 384)), 4, axis=0) + rng.normal(size=(n, 384)) * 0.25
    offsets = pa.array(np.arange(0, n * 384 + 1, 384, dtype=np.int32))
    columns = {"id": list(range(n)), "slug": [f"s-{i}" for i in range(n)], "category_slug": ["ab"[i // 4 % 2] for i in range(n)], "canonical_key": [f"k|{i % 3}" if i % 5 else None for i in range(n)]}
    columns |= {"specs": ["{}"] * n, "embedding": pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.float32).ravel()))}
    pq.write_table(pa.table(columns), tmp_path / "product.parquet", row_group_size=1_000)
    began = time.time()
    got = matching.merge_queue(spark, str(tmp_path)).collect()
    assert time.time() - began < 30
    duck = duckdb.connect()
    duck.sql(f"create view product as select * from '{tmp_path}/product.parquet'")
    assert len(got) == 200 and sorted((r.similarity, r.slug, r.other_slug) for r in got) == sorted(duck.sql(matching.ORACLES["merge_queue"]).fetchall())


def test_the_nearest_of_a_block_cut_into_cells(spark, monkeypatch):
    monkeypatch.setattr(resolution, "CELL", 7)
    rng = np.random.default_rng(5)
    rows, wanted = [], {}
    for block, n in (("a", 90), ("b", 20), ("c", 1)):
        ids = [len(rows) + k for k in range(n)]
        x = rng.integers(-2, 3, size=(n, 6)).astype(float)  # many copies, so many equal similarities
        x[:, 0] += 0.5
        rows += [(i, block, v) for i, v in zip(ids, x.tolist())]
        wanted |= nearest(ids, x, np.array(ids) % 3 == 0)
    rows += [(500, "a", [0.0] * 6), (501, "a", [float("nan")] + [1.0] * 5), (504, "a", [float("inf")] * 6), (507, "a", [None] + [1.0] * 5), (None, "a", rows[0][2]), (510, None, rows[0][2]), (511, None, rows[0][2]), (520, "d", rows[0][2])]
    vectors = spark.createDataFrame(rows, "id long, k string, vector array<double>").repartition(5)
    got = [tuple(r) for r in resolution.best_neighbour(vectors, vectors.filter("id % 3 = 0"), "k").collect()]
    assert len(got) == len(wanted) > 30 and {i: (o, s) for i, o, s in got} == wanted
    assert resolution.best_neighbour(vectors, vectors.filter("id < 0"), "k").count() == 0


def test_halves_of_similarities_are_rounded_as_in_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    halves = [(k + 0.5) / 10_000 for k in range(1, 9_999)]
    differ = [d for d in halves if d * 10_000 % 1 < 0.5 and np.sqrt(d * d + np.sqrt(1 - d * d) ** 2) == 1][:20]  # just below, though written as a half
    assert len(differ) == 20
    rows = [(i, str(i // 2), [1.0, 0.0] if i % 2 == 0 else [differ[i // 2], float(np.sqrt(1 - differ[i // 2] ** 2))]) for i in range(40)]
    vectors = spark.createDataFrame(rows, "id long, k string, vector array<double>")
    got = {r.id: r.similarity for r in resolution.best_neighbour(vectors, vectors.filter("id % 2 = 0"), "k").collect()}
    assert got == {2 * k: duckdb.execute("SELECT round(?::DOUBLE, 4)", [d]).fetchone()[0] for k, d in enumerate(differ)}


def test_tiles_change_nothing(monkeypatch):
    monkeypatch.setattr(resolution, "TILE", (3, 4))
    x = np.random.default_rng(7).normal(size=(50, 5))
    x[40:] = x[:10]
    units, ids = x / np.sqrt(np.cumsum(x * x, axis=1)[:, -1])[:, None], np.arange(50)
    cell = resolution._Cell([(ids[::5], units[::5]), (ids[1::5], units[1::5])])
    for part in (slice(0, 17), slice(17, 50)):
        cell.meet(ids[part], units[part])
    rows = cell.found().to_pylist()
    assert {r["id"]: (r["other"], r["similarity"]) for r in rows} == nearest(ids.tolist(), x, np.isin(ids % 5, [0, 1]))


def test_stored_tells_nothing_written_from_a_fault(spark, tmp_path):
    assert stored(spark, str(tmp_path / "nothing")) is None
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "part.parquet").write_text("no parquet")
    with pytest.raises(Exception):
        stored(spark, str(tmp_path / "broken")).count()


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        class _jsc:
            @staticmethod
            def sc():
                return Context

        @staticmethod
        def getCheckpointDir():
            return Context

        @staticmethod
        def isDefined():
            return False

        @staticmethod
        def getConf():
            return {}

    class Session:
        sparkContext, conf = Context, {}

    with pytest.raises(RuntimeError, match="checkpoint"):
        ensure_checkpoint_dir(Session)
