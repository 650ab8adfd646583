"""Offers matched to products: by key, by the deeper of two keys, or by similarity behind guards; and merges applied."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import keys
from ..session import durable
from .ranking import top_per_group
from .sizes import broadcast_below

SURE, LIKELY = 0.95, 0.90  #: similarities from which on a pair is merged if its keys agree, or put before a reviewer
CELL = 16_384  #: vectors asked for that are held in memory at a time, and vectors that meet them in one place
CELL_OF = ["block", "asked_part", "part"]
TILE = 512, 1_024  #: vectors asked for, and others, that are multiplied at a time: 4 MB of products
UNSURE = 1e-6  #: of a ten thousandth; sums of vectors of length 1 in different orders differ by less than a thousandth of it
MAX_BROADCAST_ROWS = 100_000  #: blocks with their counts sent to every worker


def deeper_key(key: Column, fallback: Column) -> Column:
    """The fallback's key if the own one is missing or has fewer segments, else the own one."""
    return F.when(key.isNull() | (keys.depth(fallback) > keys.depth(key)), F.coalesce(fallback, key)).otherwise(key)


def match_or_create(offers: DataFrame, products: DataFrame) -> DataFrame:
    """``seq``, ``key``, ``status`` and ``product_id`` or, for products to be made, ``new_slug``.

    ``offers`` has seq, key and slug (for a product made of it); ``products`` has id, key and slug. An offer is
    ``matched`` to the first product of its key. Of the offers with a new key the one with the smallest seq stands for the
    product to be made, with the first slug that any of them has: it is ``created``, the others ``joined``; a product whose slug is taken, by a product or by
    another new key with a smaller seq, can't be made, and its offers are ``rejected``. Without a key offers are ``unparsed``.
    Null slugs collide with nothing. Keys are reduced to a row each before they are joined.
    """
    known = products.filter(F.col("key").isNotNull()).groupBy("key").agg(F.min("id").alias("product_id"))
    held = offers.filter(F.col("key").isNotNull()).join(known, "key", "left")
    fresh = held.filter(F.col("product_id").isNull()).groupBy("key").agg(F.min("seq").alias("first_seq"), F.min_by("slug", F.when(F.col("slug").isNotNull(), F.col("seq"))).alias("new_slug"))
    first_of_slug = fresh.filter(F.col("new_slug").isNotNull()).groupBy("new_slug").agg(F.min("first_seq").alias("slug_seq"))
    taken = products.select(F.col("slug").alias("new_slug"), F.lit(True).alias("taken")).filter(F.col("new_slug").isNotNull()).distinct()
    made = fresh.join(first_of_slug, "new_slug", "left").join(taken, "new_slug", "left")
    free = F.col("taken").isNull() & (F.col("slug_seq").isNull() | (F.col("slug_seq") == F.col("first_seq")))
    made = made.select("key", "first_seq", "new_slug", free.alias("free"))
    status = F.when(F.col("product_id").isNotNull(), "matched").when(~F.col("free"), "rejected").when(F.col("seq") == F.col("first_seq"), "created").otherwise("joined")
    matched = held.join(made, "key", "left").select("seq", "key", status.alias("status"), "product_id", F.when(F.col("product_id").isNull() & F.col("free"), F.col("new_slug")).alias("new_slug"))
    unparsed = offers.filter(F.col("key").isNull()).select("seq", "key", F.lit("unparsed").alias("status"), F.lit(None).cast("long").alias("product_id"), F.lit(None).cast("string").alias("new_slug"))
    return matched.unionByName(unparsed)


def merge_decision(similarity: Column, key: Column, specs: Column, other_key: Column, other_specs: Column) -> Column:
    """``none`` where numbers contradict each other or the pair isn't similar enough, ``merge`` where it is nearly equal and
    so are the keys, else ``queue``."""
    conflict = F.coalesce(keys.numeric_conflict(specs, other_specs), F.lit(False)) | F.coalesce(keys.positional_conflict(key, other_key), F.lit(False))
    agree = F.coalesce(keys.loosely_equal(key, other_key), F.lit(False))
    return F.when(conflict | F.coalesce(similarity < LIKELY, F.lit(True)), "none").when((similarity >= SURE) & agree, "merge").otherwise("queue")


def moved_offers(offers: DataFrame, winners: DataFrame) -> DataFrame:
    """``id``, ``product_id`` and ``action`` of every offer once products are merged into their winners.

    ``offers`` has id, product_id and merchant_id; ``winners`` has product_id and winner. A product keeps one offer of a
    merchant: the winner's own, then the one with the smallest id. Others of the merchant that come with merged products
    are ``dropped``, the rest ``moved``; offers that were the winner's before are all ``kept``.
    """
    led = offers.join(winners, "product_id", "left").withColumn("target", F.coalesce("winner", "product_id")).withColumn("own", F.col("target").eqNullSafe(F.col("product_id")))
    first = top_per_group(led.filter(F.col("target").isNotNull()), ["target", "merchant_id"], [F.col("own").desc(), F.col("id")]).select("id", F.lit(True).alias("stays"))
    action = F.when(F.col("own"), "kept").when(F.col("stays"), "moved").otherwise("dropped")
    return led.join(first, "id", "left").select("id", F.when(action != "dropped", F.col("target")).alias("product_id"), action.alias("action"))


def best_neighbour(vectors: DataFrame, asked: DataFrame, block: str) -> DataFrame:
    """``id``, ``other`` and ``similarity`` of the most similar vector of the same block, for the vectors asked for.

    ``vectors`` and ``asked`` have a BIGINT id, the block and ``vector``, all of one length. The cosine is rounded to four
    places, of equal ones the smallest id counts; vectors that have no direction are left out. Every vector asked for meets
    every vector of its block: a block is cut into cells of at most about ``CELL`` vectors of either kind, by their ids. Only blocks
    with more than ``CELL`` asked ones have vectors sent to several places; vectors are shuffled as they are stored and
    brought to length 1 where they meet.
    """
    vectors, asked = (df.filter(F.col("id").isNotNull()).select("id", block, "vector") for df in (vectors, asked))
    cells = vectors.groupBy(block).agg(F.count(F.lit(1)).alias("n")).join(asked.groupBy(block).agg(F.count(F.lit(1)).alias("n_asked")), block)
    cells = broadcast_below(durable(cells.select(block, F.ceil(F.col("n") / CELL).alias("parts"), F.ceil(F.col("n_asked") / CELL).alias("asked_parts"))), MAX_BROADCAST_ROWS)
    part, asked_part = F.pmod(F.xxhash64("id"), F.col("parts")), F.pmod(F.xxhash64("id"), F.col("asked_parts"))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    met = vectors.join(cells, block).select(F.col(block).alias("block"), part.alias("part"), each("asked_parts").alias("asked_part"), F.lit(False).alias("asks"), "id", "vector")
    asking = asked.join(cells, block).select(F.col(block).alias("block"), each("parts").alias("part"), asked_part.alias("asked_part"), F.lit(True).alias("asks"), "id", "vector")
    together = asking.unionByName(met).repartition(*CELL_OF).sortWithinPartitions(*CELL_OF, F.col("asks").desc(), "id")
    best = F.row_number().over(W.partitionBy("id").orderBy(F.col("similarity").desc(), "other"))
    return together.mapInArrow(_nearest, "id long, other long, similarity double").withColumn("nth", best).filter("nth = 1").drop("nth")


def _in_order(products: np.ndarray) -> np.ndarray:
    """The sum of every row, added up from the first on as SQL does, which ``sum`` doesn't."""
    return np.cumsum(products, axis=1)[:, -1]


def _units(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors of the rows, without those that are all zero or not finite."""
    x = rows.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows.num_rows, -1)
    with np.errstate(all="ignore"):
        length = np.sqrt(_in_order(x * x))
    sound = (length > 0) & (length < np.inf)
    return rows.column("id").to_numpy()[sound], x[sound] / length[sound, None]


def _ten_thousandths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The dot products of all rows in ten thousandths, rounded as SQL rounds them.

    A matrix product adds in another order, so what lies within ``UNSURE`` of a half, far more than the orders differ by,
    is added up again in order.
    """
    dots = a @ b.T
    dots *= 10_000
    rounded = np.rint(dots)
    dots -= rounded
    i, j = np.nonzero(np.abs(dots, out=dots) > 0.5 - UNSURE)
    for k in range(0, len(i), TILE[1]):
        at = i[k : k + TILE[1]], j[k : k + TILE[1]]
        exact = _in_order(a[at[0]] * b[at[1]]) * 10_000
        whole = np.floor(np.abs(exact))
        rounded[at] = np.copysign(whole + (np.abs(exact) - whole >= 0.5), exact)
    return rounded


class _Cell:
    """The vectors asked for in one cell, and the best that each has met so far."""

    def __init__(self, held: list[tuple[np.ndarray, np.ndarray]]):
        self.ids, self.units = (np.concatenate(x) for x in zip(*held))
        self.top, self.other = np.full(len(self.ids), -np.inf), np.zeros(len(self.ids), dtype=np.int64)

    def meet(self, ids: np.ndarray, units: np.ndarray) -> None:
        """Further vectors, in the order of their ids: the first of equal ones stays."""
        for a in range(0, len(self.ids), TILE[0]):
            mine = slice(a, a + TILE[0])
            for b in range(0, len(ids), TILE[1]):
                theirs = slice(b, b + TILE[1])
                scores = _ten_thousandths(self.units[mine], units[theirs])
                scores[self.ids[mine, None] == ids[None, theirs]] = -np.inf
                at = scores.argmax(axis=1)
                top = scores[np.arange(len(at)), at]
                better = top > self.top[mine]
                self.top[mine] = np.where(better, top, self.top[mine])
                self.other[mine] = np.where(better, ids[theirs][at], self.other[mine])

    def found(self) -> pa.RecordBatch:
        some = self.top > -np.inf
        return pa.RecordBatch.from_arrays([pa.array(self.ids[some]), pa.array(self.other[some]), pa.array(self.top[some] / 10_000 + 0.0)], ["id", "other", "similarity"])


def _nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The best of every vector asked for in its cell; a cell's rows follow each other, those asked for first."""
    here, held, cell = None, [], None
    for batch in batches:
        places = list(zip(*(batch.column(c).to_pylist() for c in CELL_OF)))
        starts = [k for k in range(len(places)) if not k or places[k] != places[k - 1]]
        for start, end in zip(starts, [*starts[1:], len(places)]):
            if places[start] != here:
                if cell:
                    yield cell.found()
                here, held, cell = places[start], [], None
            rows = batch.slice(start, end - start)
            asking = pc.sum(rows.column("asks")).as_py() or 0
            if asking:
                held.append(_units(rows.slice(0, asking)))
            if held and asking < rows.num_rows:
                cell = cell or _Cell(held)
                cell.meet(*_units(rows.slice(asking)))
    if cell:
        yield cell.found()


def unit_vector(vector: Column) -> Column:
    """The vector in doubles at length 1; null if it is null, empty, all zero or not finite."""
    numbers = vector.cast("array<double>")
    length = F.sqrt(F.aggregate(numbers, F.lit(0.0), lambda s, v: s + v * v))
    # as the element of an array the length is reckoned once, not once for every number
    return F.transform(F.array(length), lambda n: F.when((n > 0) & (n < float("inf")) & ~F.isnan(n), F.transform(numbers, lambda v: v / n)))[0]
