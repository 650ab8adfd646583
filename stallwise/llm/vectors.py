"""The most similar vectors of every vector, by multi-probe p-stable hashing.

A vector's unit form is projected on Gaussian directions; a table's bucket is the tuple of its quantised projections.
Besides its own bucket, a vector visits those next to it in the order of their estimated chance of holding neighbours.
The candidates of all tables are merged and reranked by exact cosine.

Copies of a vector, scaled ones included, are handled once: one representative is hashed, and the copies with the smallest ids stand for all.
Vectors that meet in a bucket with too many different vectors are a crowd with all that these meet in other such buckets.
A crowd is compared block by block, all blocks with all blocks, by exact cosine; nothing of it is left out.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.sizes import broadcast_below
from ..session import durable

TABLES = 10  #: at TABLES_AT projections or fewer; with more there are more, see tables_for
TABLES_AT = 15
SURE_COSINE = 0.8  #: a pair of this cosine is as likely to meet at any number of projections
PROBES = 20
WIDTH = 2.3  #: of a quantisation step, for vectors of length 1
BUCKET = 400  #: different vectors a bucket may hold before all that visit it are compared exactly
BLOCK = 16_384  #: vectors of a crowd held in memory at a time, twice
SKETCH_DEVIATIONS = 3  #: a candidate is reranked if its sketch differs in at most so many deviations more bits than the least cosine lets expect
BITMAP_LOG2 = (25, 29)  #: bits that remember which buckets exist, as powers of two: from 4 MB on, 64 MB at most; a full map only spares fewer probes
HOME = 2_000  #: vectors compared at one place; where more come together, pairs are joined one by one
MAX_BROADCAST_ROWS = 1_000_000  #: pairs of ids sent to every worker; more are joined by a shuffle
SEED = 20240917


@lru_cache(maxsize=64)
def probe_sets(k: int, probes: int) -> tuple[tuple[int, ...], ...]:
    """The first sets of perturbations by expected score; entries are ranks among the 2k sorted boundary distances."""
    ranks = np.arange(1, 2 * k + 1)
    near = ranks <= k
    expected = np.where(near, ranks * (ranks + 1) / (4 * (k + 1) * (k + 2)), 1 - (2 * k + 1 - ranks) / (k + 1) + (2 * k + 1 - ranks) * (2 * k + 2 - ranks) / (4 * (k + 1) * (k + 2)))
    heap, found = [(expected[0], (0,))], []
    while heap and len(found) < probes:
        score, chosen = heapq.heappop(heap)
        if all(2 * k - 1 - i not in chosen for i in chosen):  # not both sides of one projection
            found.append(chosen)
        last = chosen[-1]
        if last + 1 < 2 * k:
            heapq.heappush(heap, (score - expected[last] + expected[last + 1], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (score + expected[last + 1], (*chosen, last + 1)))
    return tuple(found)


@lru_cache(maxsize=64)
def meeting_chance(k: int) -> float:
    """The chance that two vectors at ``SURE_COSINE`` meet in a table of k projections, by own or probed bucket, from 100,000 draws."""
    rng = np.random.default_rng([SEED, k])
    x = rng.uniform(size=(100_000, k))
    y = x + rng.normal(size=x.shape) * math.sqrt(2 - 2 * SURE_COSINE) / WIDTH
    of_rank = rng.integers(1, 2**63, size=2 * k, dtype=np.uint64)
    visited = np.array([0, *(sum(map(int, of_rank[list(chosen)])) % 2**64 for chosen in probe_sets(k, PROBES))], dtype=np.uint64)
    met = np.zeros(len(x), dtype=bool)
    for a, b in ((x, y), (y, x)):
        inside, step = a - np.floor(a), np.floor(b) - np.floor(a)
        order = np.argsort(np.concatenate([inside**2, (1 - inside) ** 2], axis=1), axis=1)
        needed = np.take_along_axis(np.concatenate([step == -1, step == 1], axis=1), order, axis=1)
        with np.errstate(over="ignore"):
            met |= np.isin((needed * of_rank).sum(axis=1, dtype=np.uint64), visited) & (np.abs(step) <= 1).all(axis=1)
    return float(met.mean())


def tables_for(k: int) -> int:
    """Tables with which a pair at ``SURE_COSINE`` is found as surely as with ``TABLES`` at ``TABLES_AT`` projections."""
    if k <= TABLES_AT:
        return TABLES
    return math.ceil(TABLES * math.log1p(-meeting_chance(TABLES_AT)) / math.log1p(-meeting_chance(k)))


@lru_cache(maxsize=8)
def _directions(dims: int, k: int, tables: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Projections and offsets of all tables, odd multipliers that turn buckets into keys, and the sketch's planes."""
    rng = np.random.default_rng([SEED, 0])
    a = rng.normal(size=(dims, tables * k)).astype(np.float32) / np.float32(WIDTH)
    b = rng.uniform(0, 1, size=tables * k).astype(np.float32)
    odd = rng.integers(0, 2**63, size=tables * k, dtype=np.uint64) | np.uint64(1)
    return a, b, odd, np.random.default_rng(SEED + 1).normal(size=(dims, 128)).astype(np.float32)


def _matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, dims).astype(np.float64)


def hash_keys(x: np.ndarray, k: int, tables: int, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket keys (rows, tables) and the keys of the probed buckets (rows, tables, probes) of unit vectors."""
    a, b, odd, _ = _directions(x.shape[1], k, tables)
    at = x.astype(np.float32) @ a + b
    cell = np.floor(at)
    inside = (at - cell).reshape(len(x), tables, k)
    with np.errstate(over="ignore"):
        steps = cell.astype(np.int64).astype(np.uint64) * odd
        own = steps.reshape(len(x), tables, k).sum(axis=2, dtype=np.uint64) + np.arange(tables, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        distance = np.concatenate([inside**2, (1 - inside) ** 2], axis=2)
        order = np.argsort(distance, axis=2)
        multiplier = odd.reshape(1, tables, k)
        shift = np.concatenate([np.broadcast_to(np.uint64(0) - multiplier, inside.shape), np.broadcast_to(multiplier, inside.shape)], axis=2)
        ranked = np.take_along_axis(shift, order, axis=2)
        probed = [own + reduce(np.add, [ranked[:, :, i] for i in chosen]) for chosen in probe_sets(k, probes)]
    return own, np.stack(probed, axis=2) if probed else np.zeros((*own.shape, 0), dtype=np.uint64)


def sketch(x: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """128 sign bits in two BIGINTs."""
    bits = np.packbits(x.astype(np.float32) @ planes > 0, axis=1)
    return bits.view(np.int64).reshape(len(x), 2)


def sketch_limit(least: float) -> int:
    """Differing bits of 128 up to which a candidate may have the cosine ``least``."""
    chance = math.acos(min(max(least, -1.0), 1.0)) / math.pi
    return math.ceil(128 * chance + SKETCH_DEVIATIONS * math.sqrt(128 * chance * (1 - chance)))


def bitmap_bits(keys: int) -> int:
    """The power of two of a bitmap with eight bits for every key, within ``BITMAP_LOG2``."""
    return min(max(math.ceil(math.log2(max(8 * keys, 1))), BITMAP_LOG2[0]), BITMAP_LOG2[1])


def _bit(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - bits)).astype(np.int64)


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _of_length(df: DataFrame, record: str, vector: str, dims: int) -> DataFrame:
    rows = df.select(F.col(record).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("embedding"))
    return rows.filter(F.col("id").isNotNull() & (F.size("embedding") == dims))


def _sound(batch: pa.RecordBatch, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of the rows whose numbers are finite and not all zero."""
    m = _matrix(batch, dims)
    good = np.isfinite(m).all(axis=1) & (m != 0).any(axis=1)
    return batch.column("id").to_numpy()[good], m[good]


def _members(rows: DataFrame, dims: int) -> DataFrame:
    """``id`` and a 128-bit hash ``h1``, ``h2`` of each sound vector's unit form; 11 digits, so that its copies are equal to the nine of a similarity."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids, m = _sound(batch, dims)
                digest = b"".join(hashlib.blake2b(v.tobytes(), digest_size=16).digest() for v in np.round(_unit(m), 11) + 0.0)
                halves = np.frombuffer(digest, dtype=np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(halves[:, 0]), pa.array(halves[:, 1])], names=["id", "h1", "h2"])

    return rows.mapInArrow(work, "id long, h1 long, h2 long")


def _base_buckets(vectors: DataFrame, dims: int, k: int, tables: int, map_bits: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, m = _sound(batch, dims)
            x = _unit(m)
            own, _ = hash_keys(x, k, tables, 0)
            bits = sketch(x, _directions(dims, k, tables)[3])
            columns = [own.reshape(-1).view(np.int64), np.repeat(ids, tables), *[np.repeat(bits[:, i], tables) for i in (0, 1)], _bit(own.reshape(-1), map_bits)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["bucket", "id", "s1", "s2", "bit"])

    return vectors.mapInArrow(work, "bucket long, id long, s1 long, s2 long, bit long")


def _existing(base: DataFrame, map_bits: int = BITMAP_LOG2[0]) -> np.ndarray:
    """The bitmap of buckets that hold anything, built map-side; its size is bounded."""
    parts = base.groupBy(F.bitmap_bucket_number("bit").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect()
    bitmap = np.zeros((2 ** (map_bits - 15) + 2, 4096), dtype=np.uint8)
    for part, bits in parts:
        bitmap[part, : len(bits)] = np.frombuffer(bits, dtype=np.uint8)
    return bitmap


def _held(bitmap: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """Whether the bits are set; parts are numbered from 1, after 32,768 bits each, as the database functions do it."""
    part = np.where(bit > 0, 1 + (bit - 1) // 32768, -(-bit // 32768))
    position = np.where(bit > 0, (bit - 1) % 32768, -bit % 32768)
    return (bitmap[part, position // 8] >> (position % 8).astype(np.uint8)) & 1 == 1


def _probes(spark: SparkSession, vectors: DataFrame, dims: int, k: int, tables: int, bitmap: np.ndarray, map_bits: int) -> DataFrame:
    shared = spark.sparkContext.broadcast(bitmap)  # of bounded size
    step = max(1, 2000 * TABLES // tables)  # vectors probed at a time, so that memory stays the same

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, step) for i in range(0, whole.num_rows, step)):
                ids, m = _sound(batch, dims)
                x = _unit(m)
                _, probed = hash_keys(x, k, tables, PROBES)
                flat = probed.reshape(-1)
                hit = np.flatnonzero(_held(shared.value, _bit(flat, map_bits)))
                rows = hit // (tables * PROBES)
                bits = sketch(x, _directions(dims, k, tables)[3])
                columns = [flat[hit].view(np.int64), ids[rows], bits[rows, 0], bits[rows, 1]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["bucket", "id", "s1", "s2"])

    return vectors.mapInArrow(work, "bucket long, id long, s1 long, s2 long")


def candidate_pairs(vectors: DataFrame, count: int, dims: int, least: float = SURE_COSINE) -> tuple[DataFrame, DataFrame | None]:
    """Distinct pairs ``a`` < ``b`` of ids that met in a bucket and whose sketches are close enough, and the crowds.

    Crowds are ``id`` and ``crowd``, or None without any. Pairs within a crowd are not among the pairs.
    """
    k = max(8, math.ceil(math.log2(max(count, 2))) + 3)  # so that strangers met in a table stay as few at any size
    tables = tables_for(k)
    map_bits = bitmap_bits(count * tables)
    base = durable(_base_buckets(vectors, dims, k, tables, map_bits))
    probes = _probes(vectors.sparkSession, vectors, dims, k, tables, _existing(base, map_bits), map_bits)
    base = base.drop("bit")
    hot = durable(base.groupBy("bucket").agg(F.count(F.lit(1)).alias("held")).filter(F.col("held") > BUCKET))
    crowds = None
    if not hot.isEmpty():
        probes = durable(probes)
        crowds = _crowds(durable(base.unionByName(probes).join(hot, "bucket", "left_semi").select("bucket", "id").distinct()))
        base, probes = (side.join(hot, "bucket", "left_anti").join(crowds, "id", "left") for side in (base, probes))
    return durable(_meetings(base, base.unionByName(probes), sketch_limit(least))), crowds


def _crowds(visits: DataFrame) -> DataFrame:
    """``id`` and ``crowd`` of the visitors of hot buckets; those linked by a chain of shared buckets are one crowd."""
    labels = durable(visits.groupBy("id").agg(F.min("bucket").alias("crowd")))
    while True:
        least = visits.join(labels, "id").groupBy("bucket").agg(F.min("crowd").alias("crowd"))
        following = durable(visits.join(least, "bucket").groupBy("id").agg(F.min("crowd").alias("crowd")))
        if following.join(labels, ["id", "crowd"], "left_anti").isEmpty():
            return following
        labels = following


def _meetings(base: DataFrame, visits: DataFrame, limit: int) -> DataFrame:
    held = base.withColumnsRenamed({"id": "x", "s1": "x1", "s2": "x2", "crowd": "x_crowd"})
    differing = F.bit_count(F.col("s1").bitwiseXOR(F.col("x1"))) + F.bit_count(F.col("s2").bitwiseXOR(F.col("x2")))
    met = visits.join(held, "bucket").filter((F.col("id") != F.col("x")) & (differing <= limit))
    if "crowd" in base.columns:
        met = met.filter(F.coalesce(F.col("crowd") != F.col("x_crowd"), F.lit(True)))
    return met.select(F.least("id", "x").alias("a"), F.greatest("id", "x").alias("b")).distinct()


def crowd_cosines(vectors: DataFrame, crowds: DataFrame, dims: int, k: int, least: float) -> DataFrame:
    """``x``, ``y`` and ``similarity``, in doubles, of the ``k`` most similar vectors that each block of its crowd has for ``x``.

    A crowd's ids are dealt to blocks by hash. Every two blocks, and every block with itself, meet in one task; a vector
    is sent once for each block of its crowd, so the work grows with the square of a crowd and is spread over tasks.
    """
    blocks = crowds.groupBy("crowd").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("blocks"))
    dealt = crowds.join(blocks, "crowd").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    sent = vectors.join(durable(dealt), "id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = sent.select("crowd", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "embedding")
    return met.groupBy("crowd", "i", "j").applyInArrow(_compare_blocks(dims, k, least), "x long, y long, similarity double")


def _compare_blocks(dims: int, k: int, least: float):
    def nearest(x_ids: np.ndarray, x: np.ndarray, y_ids: np.ndarray, y: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        """For each of x its k nearest of y; on similarities equal to nine digits the smaller id. ``y_ids`` ascend."""
        out = []
        for at in range(0, len(x), 256):
            similarity = x[at : at + 256] @ y.T
            similarity[x_ids[at : at + 256, None] == y_ids] = -2
            rank = np.rint(similarity * 1e9).astype(np.int64) * 2**32 - np.arange(len(y))
            best = np.argpartition(rank, -k, axis=1)[:, -k:] if len(y) > k else np.broadcast_to(np.arange(len(y)), similarity.shape)
            value = np.take_along_axis(similarity, best, axis=1)
            row, place = np.nonzero(value >= least)
            out.append((x_ids[at + row], y_ids[best[row, place]], value[row, place]))
        return out

    def work(block_pair: pa.Table) -> pa.Table:
        block_pair = block_pair.combine_chunks()
        ids, first = np.unique(block_pair.column("id").to_numpy(), return_index=True)  # repeated rows count once
        x = _unit(_matrix(block_pair.to_batches()[0], dims)[first]) if len(ids) else np.zeros((0, dims))
        block = block_pair.column("block").to_numpy()[first]
        sides = [np.flatnonzero(block == b) for b in np.unique(block)]
        found = [n for own in sides for other in (sides if len(sides) == 1 else [o for o in sides if o is not own]) for n in nearest(ids[own], x[own], ids[other], x[other])]
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)]
        return pa.table(dict(zip(("x", "y", "similarity"), columns)))

    return work


def exact_cosines(vectors: DataFrame, pairs: DataFrame, dims: int) -> DataFrame:
    """``a``, ``b`` and ``similarity`` of the pairs, in doubles.

    Vectors travel to a home, the smallest id among a vector's candidates and itself. Candidates that share a home, as
    the members of a cluster do, are compared there; other pairs, and those of homes with too many vectors, fetch theirs.
    """
    ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("a").alias("near")), F.struct(F.col("b").alias("id"), F.col("a").alias("near")))).alias("e"))
    homes = ends.select("e.*").groupBy("id").agg(F.min("near").alias("home"))
    crowd = homes.groupBy("home").agg(F.count(F.lit(1)).alias("members"))
    homes = homes.join(crowd.filter(F.col("members") <= HOME), "home", "left_semi").select("id", "home")
    homes = broadcast_below(durable(homes), MAX_BROADCAST_ROWS)
    placed = (
        pairs.join(homes.select(F.col("id").alias("a"), F.col("home").alias("home_a")), "a", "left")
        .join(homes.select(F.col("id").alias("b"), F.col("home").alias("home_b")), "b", "left")
        .select("a", "b", F.when(F.col("home_a") == F.col("home_b"), F.col("home_a")).alias("home"))
    )
    placed = durable(placed)
    members = vectors.join(homes, "id").select("home", F.col("id").alias("a"), F.lit(-1).cast("long").alias("b"), "embedding")
    wanted = placed.filter("home IS NOT NULL").select("home", "a", "b", F.lit(None).cast("array<float>").alias("embedding"))
    gathered = members.unionByName(wanted).repartition("home").sortWithinPartitions("home", "b")
    together = gathered.mapInArrow(_compare_at_home(dims), "a long, b long, similarity double")
    apart = placed.filter("home IS NULL").select("a", "b")
    fetched = (
        apart.join(vectors.select(F.col("id").alias("a"), F.col("embedding").alias("va")), "a")
        .join(vectors.select(F.col("id").alias("b"), F.col("embedding").alias("vb")), "b")
    )
    return together.unionByName(fetched.mapInArrow(_compare_rows(dims), "a long, b long, similarity double"))


def _compare_at_home(dims: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, ids, vectors = None, np.zeros(0, dtype=np.int64), np.zeros((0, dims))
        for batch in batches:
            if not batch.num_rows:
                continue
            at, a, b = (batch.column(c).to_numpy() for c in ("home", "a", "b"))
            is_vector = b < 0
            rows = batch.filter(pa.array(is_vector))
            fresh = _unit(_matrix(rows, dims)) if rows.num_rows else np.zeros((0, dims))
            keep = np.array([home == at[0]] * len(ids), dtype=bool)
            ids, vectors = np.concatenate([ids[keep], a[is_vector]]), np.concatenate([vectors[keep], fresh])
            order = np.argsort(ids)
            if (~is_vector).any():
                left, right = (order[np.searchsorted(ids, end[~is_vector], sorter=order)] for end in (a, b))
                similarity = np.einsum("ij,ij->i", vectors[left], vectors[right])
                yield pa.RecordBatch.from_arrays([pa.array(a[~is_vector]), pa.array(b[~is_vector]), pa.array(similarity)], names=["a", "b", "similarity"])
            home = at[-1]
            if is_vector.any():
                owner = np.concatenate([np.full(len(ids) - is_vector.sum(), at[0]), at[is_vector]])
                ids, vectors = ids[owner == home], vectors[owner == home]
            elif home != at[0]:
                ids, vectors = ids[:0], vectors[:0]

    return work


def _compare_rows(dims: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                left, right = (_unit(batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.float64)) for c in ("va", "vb"))
                similarity = np.einsum("ij,ij->i", left, right)
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(similarity)], names=["a", "b", "similarity"])

    return work


def most_similar(df: DataFrame, record: str = "id", vector: str = "embedding", dims: int = 384, k: int = 5, least: float = 0.8) -> DataFrame:
    """``id``, ``neighbour``, ``similarity`` and ``place`` (1 to k) of each row's most similar other rows.

    Only neighbours of a cosine of ``least`` or more, which should be 0.6 or more, come out; on equal similarity the
    smaller id first. Rows whose id or vector is null, and vectors of another length, all zero or not finite take no
    part. Repeated rows count once; of different vectors under one id the one with the smallest hash stands. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    rows = _of_length(df, record, vector, dims)
    hashes = _members(rows, dims).groupBy("id").agg(F.min(F.struct("h1", "h2")).alias("h"))
    members = durable(hashes.select("id", "h.h1", "h.h2"))
    first = W.partitionBy("h1", "h2").orderBy("id")
    eldest = durable(members.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= k + 1))
    representatives = eldest.filter("nth = 1").select("id", "h1", "h2")
    others = durable(members.join(representatives.select("id"), "id", "left_anti").select("id"))
    vectors = rows.join(broadcast_below(others, MAX_BROADCAST_ROWS), "id", "left_anti")
    pairs, crowds = candidate_pairs(vectors, representatives.count(), dims, least)
    similar = exact_cosines(vectors, pairs, dims).filter(F.col("similarity") >= least).dropDuplicates(["a", "b"])
    both = similar.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("p"), "similarity")
    both = both.select("p.x", "p.y", "similarity")
    if crowds is not None:
        both = both.unionByName(crowd_cosines(vectors, crowds, dims, k, least))
    own = representatives.select(F.col("id").alias("x"), F.col("id").alias("y"), F.lit(1.0).alias("similarity"))
    groups = both.select("x", "y", F.round("similarity", 9).alias("similarity")).unionByName(own)
    copies = eldest.join(representatives.select(F.col("id").alias("y"), "h1", "h2"), ["h1", "h2"]).select("y", F.col("id").alias("neighbour"))
    ranked = W.partitionBy("x").orderBy(F.col("similarity").desc(), "neighbour")
    nearest = groups.join(copies, "y").withColumn("nth", F.row_number().over(ranked)).filter(F.col("nth") <= k + 1)
    kept = nearest.groupBy("x").agg(F.array_sort(F.collect_list(F.struct("nth", "neighbour", "similarity"))).alias("near"))
    # A group's list serves all its copies; each leaves itself out.
    by_group = kept.join(representatives.select(F.col("id").alias("x"), "h1", "h2"), "x").select("h1", "h2", "near")
    without = F.slice(F.filter("near", lambda n: n["neighbour"] != F.col("id")), 1, k)
    return (
        members.join(by_group, ["h1", "h2"])
        .select("id", F.posexplode(without).alias("at", "n"))
        .select("id", F.col("n.neighbour").alias("neighbour"), F.col("n.similarity").alias("similarity"), (F.col("at") + 1).alias("place"))
    )
