"""A mixture of documents whose sources approach target shares of all tokens.

Soft membership: a classifier learned from the labelled documents gives every document its probabilities of belonging to
each source; a label counts as strong evidence beside the text. Every document has a rate, the expected number of its
copies, between 0 and the repeats that its source may have. Projected gradient descent fits the rates so that the sources'
expected tokens match their targets in least squares; each step needs the sources' totals alone, so the documents stay
where they are.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import durable
from .language import words_of
from .tokens import VOCABULARY, count_tokens

BUCKETS = 1 << 12  #: hashed words of the classifier
STEPS = 100  #: steps at most; a fit that isn't settled by then warns
ENOUGH = 1e-4  #: largest change of a source's share in a step at which the steps end
EVIDENCE = 20  #: independent words that a text counts as, whatever its length, as its words repeat each other
SMOOTHING = 1_000  #: words of all sources' common distribution added to each, so that small ones aren't put at a disadvantage
LABEL_TRUST = 0.99  #: probability that a label alone gives its source; the text decides on the rest
SLICE = 500_000  #: documents in whose order rates are rounded together, over all sources
MAX_SOURCES = 1_000
OTHER = ""  #: stands for all sources without a target


def source_name(source: Column) -> Column:
    """The source in lower case with single hyphens; null if there is none."""
    name = F.regexp_replace(F.lower(F.trim(source)), r"[\s_-]+", "-")
    return F.when(name != "", name)


def hash_word(word: str) -> int:
    """A bucket that is the same in every process."""
    value = 2166136261
    for byte in word.encode():
        value = ((value ^ byte) * 16777619) & 0xFFFFFFFF
    return (value ^ (value >> 15)) % BUCKETS


def _read(vocabulary: str):
    """Each text becomes its number of tokens and the buckets of its words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            words = [words_of(t).split() for t in texts]
            codes, distinct = pd.factorize(np.array([w for ws in words for w in ws], dtype=object))
            if len(seen) > 200_000:
                seen.clear()
            for word in distinct:
                if word not in seen:
                    seen[word] = hash_word(word)
            buckets = np.array([seen[w] for w in distinct], dtype=np.int32)[codes] if len(distinct) else np.zeros(0, dtype=np.int32)
            offsets = np.concatenate([[0], np.cumsum([len(ws) for ws in words])]).astype(np.int32)
            tokens = pa.array([count_tokens(t, vocabulary) for t in texts], pa.int64())
            columns = [batch.column("doc_id"), batch.column("domain"), batch.column("chance"), tokens, pa.ListArray.from_arrays(pa.array(offsets), pa.array(buckets))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "domain", "chance", "n_tokens", "words"])

    return work


READ = "doc_id long, domain long, chance double, n_tokens long, words array<int>"


def _words(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buckets of all texts one after the other, where each text begins, and its number of words."""
    column = batch.column("words")
    offsets = column.offsets.to_numpy()
    return column.flatten().to_numpy(), offsets[:-1] - offsets[0], np.diff(offsets)


def _domains(batch: pa.RecordBatch) -> np.ndarray:
    """The number of each document's source, -1 where it isn't known."""
    return np.nan_to_num(batch.column("domain").to_numpy(zero_copy_only=False).astype(float), nan=-1).astype(np.int64)


def _word_counts(read: DataFrame, n: int) -> np.ndarray:
    """Words by source and bucket over all documents of known source; the result is of fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(n * BUCKETS, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                buckets, _, lengths = _words(batch)
                counts += np.bincount(np.repeat(_domains(batch), lengths) * BUCKETS + buckets, minlength=n * BUCKETS)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held])], names=["cell", "n"])

    rows = read.filter("domain IS NOT NULL").select("domain", "words").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(n * BUCKETS)
    counts[rows["cell"].to_numpy(dtype=int)] = rows["n"]
    return counts.reshape(n, BUCKETS)


def memberships(read: DataFrame, n: int) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``booked`` and ``membership``, the probabilities of the ``n`` sources.

    A naive Bayes classifier weighs the text's words by their mean, a text counting as ``EVIDENCE`` words, and the sources
    by their documents. A label has the weight of ``LABEL_TRUST``. A document is booked to the source of its label, or to
    one drawn from its probabilities by ``chance``, a number from 0 to 1.
    """
    counts = _word_counts(read, n)
    known = dict(read.filter("domain IS NOT NULL").groupBy("domain").count().collect())  # a row a source
    seen = np.array([known.get(i, 0) for i in range(n)], dtype=float)
    prior = np.where(seen > 0, np.log(np.maximum(seen, 1)), -np.inf) if seen.any() else np.zeros(n)  # no document is of a source that none is known of
    everywhere = (counts.sum(axis=0) + 0.5) / (counts.sum() + 0.5 * BUCKETS)
    spread = np.log(counts + SMOOTHING * everywhere) - np.log(counts.sum(axis=1, keepdims=True) + SMOOTHING)
    shared = read.sparkSession.sparkContext.broadcast((prior, np.ascontiguousarray(spread.T)))  # of fixed size: buckets times sources

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prior, spread = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            buckets, starts, lengths = _words(batch)
            level = np.tile(prior, (batch.num_rows, 1))
            held = np.flatnonzero(lengths)
            if len(held):
                level[held] += np.add.reduceat(spread[buckets], starts[held], axis=0) / lengths[held, None] * EVIDENCE
            p = np.exp(level - level.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            domain = _domains(batch)
            labelled = np.flatnonzero(domain >= 0)
            p[labelled] *= 1 - LABEL_TRUST
            p[labelled, domain[labelled]] += LABEL_TRUST
            drawn = (np.cumsum(p, axis=1) < batch.column("chance").to_numpy()[:, None]).sum(axis=1)
            booked = np.where(domain >= 0, domain, np.minimum(drawn, p.shape[1] - 1))
            offsets = np.arange(batch.num_rows + 1, dtype=np.int32) * p.shape[1]
            columns = [batch.column("doc_id"), batch.column("n_tokens"), pa.array(booked), pa.ListArray.from_arrays(pa.array(offsets), pa.array(p.reshape(-1)))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "booked", "membership"])

    return read.mapInArrow(classify, "doc_id long, n_tokens long, booked long, membership array<double>")


def _rates(membership: np.ndarray, cap: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """The rates after the given steps, from a rate of 1 or the cap; each step is projected on 0 to the cap."""
    rate = np.minimum(1.0, cap)
    for step in steps:
        rate = np.clip(rate - membership @ step, 0.0, cap)
    return rate


def fitted(members: DataFrame, targets: np.ndarray, repeats: np.ndarray, total: float | None = None) -> tuple[DataFrame, list[np.ndarray]]:
    """``doc_id``, ``n_tokens``, ``booked`` and ``rate``, and the steps that led there.

    ``total`` is the size of the mixture in tokens; by default the largest at which every source that exists can reach
    its target within its repeats. A rate stays within the repeats of the source that the document is booked to. The
    steps end when no source's share changes by ``ENOUGH`` any more; a fit that isn't there after ``STEPS`` warns.
    """
    n = len(targets)

    def totals(steps: list[np.ndarray]) -> np.ndarray:
        """By source: tokens, those within its repeats, and those at the rates after the steps."""

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((3, n))
            for batch in batches:
                if batch.num_rows:
                    m, cap, tokens = _soft(batch, repeats)
                    sums += np.stack([tokens, tokens * cap, tokens * _rates(m, cap, steps)]) @ m
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), *map(pa.array, sums)], names=["domain", "mass", "reach", "used"])

        names = ["mass", "reach", "used"]
        rows = members.mapInArrow(add, "domain long, mass double, reach double, used double").groupBy("domain").agg(*[F.sum(c).alias(c) for c in names]).toPandas()
        sums = np.zeros((3, n))
        sums[:, rows["domain"].to_numpy(dtype=int)] = rows[names].to_numpy().T
        return sums

    mass, reach, used = totals([])
    reachable = (targets > 0) & (mass >= 1)
    if total is None:
        total = float(np.min(reach[reachable] / targets[reachable])) if reachable.any() else 0.0
    steps: list[np.ndarray] = []
    change = math.inf if used.sum() > 0 else 0.0
    while change >= ENOUGH and len(steps) < STEPS:
        # The gradient of the squared misses, scaled by what a unit of rate adds to each source.
        steps.append(np.where(mass > 0, (used - targets * total) / np.maximum(mass, 1e-9), 0.0))
        before = used / max(used.sum(), 1e-9)
        used = totals(steps)[2]
        change = np.abs(used / max(used.sum(), 1e-9) - before).max()
    if change >= ENOUGH:
        warnings.warn(f"the shares still changed by {change:.2g} after {STEPS} steps", stacklevel=2)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                m, cap, _ = _soft(batch, repeats)
                columns = [batch.column(c) for c in ("doc_id", "n_tokens", "booked")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(_rates(m, cap, steps))], names=["doc_id", "n_tokens", "booked", "rate"])

    return members.mapInArrow(apply, "doc_id long, n_tokens long, booked long, rate double"), steps


def _soft(batch: pa.RecordBatch, repeats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Memberships, caps of the rates, and tokens of the documents."""
    m = batch.column("membership").flatten().to_numpy().reshape(batch.num_rows, len(repeats))
    return m, repeats[batch.column("booked").to_numpy()], batch.column("n_tokens").to_numpy().astype(float)


def mixture(documents: DataFrame, targets: DataFrame, total: float | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """Every document with its number of ``copies`` in the mixture: ``doc_id``, ``source``, ``n_tokens``, ``rate``, ``copies``.

    ``documents`` has doc_id, text and source, ``targets`` (at most ``MAX_SOURCES`` rows) source, target_share and
    max_repeats. ``source`` is the one that spelling variants share, or one drawn from the classifier's probabilities for
    documents without one; no document has more copies than its source may have. Rates become whole copies along each
    source's documents in the order of their size, so that what rounding leaves over goes to a document of nearly the same
    size; large sources are cut into slices by a hash for that. Sources without a target get no copies. Repeated rows are documents of their own; null and empty texts have no tokens and no copies.
    """
    wanted = targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats").filter("source IS NOT NULL")
    rows = wanted.groupBy("source").agg(F.sum("target_share"), F.max("max_repeats")).orderBy("source").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources have a target")
    names = [r[0] for r in rows] + [OTHER]
    shares, repeats = np.array([*(float(r[1] or 0) for r in rows), 0.0]), np.array([*(float(r[2] or 0) for r in rows), 0.0])
    numbers = F.create_map(*[F.lit(x) for i, name in enumerate(names[:-1]) for x in (name, i)]) if rows else F.create_map(F.lit("?"), F.lit(0))
    name = source_name(F.col("source"))
    domain = F.when(name.isNotNull(), F.coalesce(numbers[name], F.lit(len(names) - 1))).cast("long")
    chance = (F.pmod(F.xxhash64("doc_id"), F.lit(2**32)) / F.lit(2.0**32)).alias("chance")
    read = durable(documents.select("doc_id", domain.alias("domain"), chance, "text").mapInArrow(_read(vocabulary), READ))
    members = durable(memberships(read, len(names)))
    rated, _ = fitted(members, shares, repeats, total)
    labels = F.array(*[F.lit(n) for n in names])
    slices = max(1, -(-members.count() // SLICE))
    placed = rated.select("doc_id", F.get(labels, F.col("booked").cast("int")).alias("source"), "n_tokens", "rate")
    placed = durable(placed.withColumns({"slice": F.pmod(F.xxhash64("doc_id"), F.lit(slices)), "row": F.monotonically_increasing_id()}))
    along = W.partitionBy("source", "slice").orderBy(F.col("n_tokens").desc(), F.xxhash64("doc_id"), "row").rowsBetween(W.unboundedPreceding, 0)
    rate = F.when(F.col("n_tokens") > 0, F.col("rate")).otherwise(F.lit(0.0))
    upto = F.sum(rate).over(along)
    copies = F.floor(upto + 0.5 + 1e-9) - F.floor(upto - rate + 0.5 + 1e-9)
    return placed.withColumn("copies", copies.cast("long")).select("doc_id", "source", "n_tokens", "rate", "copies")


def share_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """For every source with a target: the share aimed at, the share reached, tokens, documents and the most copies.

    Sources that don't exist reach 0.
    """
    wanted = targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats")
    sums = mixed.groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count_if(F.col("copies") > 0).alias("documents"), F.max("copies").alias("most_copies")
    )
    whole = F.broadcast(sums.agg(F.sum("tokens").alias("all_tokens")))  # one row
    return (
        wanted.join(sums, "source", "left")
        .crossJoin(whole)
        .select(
            "source",
            "target_share",
            F.coalesce(F.try_divide(F.col("tokens"), F.col("all_tokens")), F.lit(0.0)).alias("reached_share"),
            F.coalesce("tokens", F.lit(0)).alias("tokens"),
            F.coalesce("documents", F.lit(0)).alias("documents"),
            F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
            "max_repeats",
        )
    )
