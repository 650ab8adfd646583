"""Deliveries as a stream: current offers and a history of changes, one micro-batch at a time.

Each batch reads the current state, folds the deliveries in arrival order, appends what changed to the history and writes
the new state beside the old one; a pointer in the folder's name, the batch's number, makes a repeated batch harmless.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.maintenance import changes_only, merged_offers
from ..sources.tables import stored

KEYS = ["merchant_slug", "page"]
STATE = ["price_kes", "in_stock", "title", "seen"]


def prepared(raw: DataFrame) -> DataFrame:
    """Deliveries with the page they are about; without a page or price they tell nothing."""
    page = F.regexp_replace("url", "[?#].*$", "")
    return raw.select("merchant_slug", page.alias("page"), "price_kes", "in_stock", "title", F.col("observed_at").alias("seen"), "seq").filter("page IS NOT NULL AND price_kes IS NOT NULL")


def folded(current: DataFrame | None, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The state after a batch and the changes on the way: the first price of an offer and every different one after."""
    spark = batch.sparkSession
    if current is None:
        current = spark.createDataFrame([], batch.select(*KEYS, *STATE).schema)
    changes = changes_only(batch, KEYS, ["seq"], "price_kes", current.select(*KEYS, "price_kes"))
    return merged_offers(current, batch, KEYS, "seq", STATE).select(*KEYS, *STATE), changes.select(*KEYS, "seq", "price_kes", "in_stock", "seen")


class Offers:
    """The state and history in a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def current(self, before: int | None = None) -> DataFrame | None:
        """The newest state, or the newest of a batch before the given one."""
        states = stored(self.spark, f"{self.folder}/state")
        if states is None:
            return None
        if before is not None:
            states = states.filter(F.col("batch") < before)
        newest = states.agg(F.max("batch")).first()[0]
        return None if newest is None else states.filter(F.col("batch") == newest).drop("batch")

    def history(self) -> DataFrame | None:
        changes = stored(self.spark, f"{self.folder}/history")
        return None if changes is None else changes.drop("batch")

    def take(self, batch: DataFrame, number: int) -> None:
        """One micro-batch; taking the same again overwrites what it wrote."""
        state, changes = folded(self.current(number), prepared(batch))
        changes.write.mode("overwrite").parquet(f"{self.folder}/history/batch={number}")
        state.write.mode("overwrite").parquet(f"{self.folder}/state/batch={number}")
        self._expire(number)

    def _expire(self, number: int) -> None:
        """Removes the states older than the one before the given batch, which a repeated batch would start from."""
        jvm, root = self.spark._jvm, f"{self.folder}/state"
        folder = jvm.org.apache.hadoop.fs.Path(root)
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        batches = sorted(int(name.split("=")[1]) for name in (f.getPath().getName() for f in files.listStatus(folder)) if name.startswith("batch="))
        for old in [b for b in batches if b < number][:-1]:
            files.delete(jvm.org.apache.hadoop.fs.Path(f"{root}/batch={old}"), True)


def ingest(stream: DataFrame, offers: Offers, checkpoint: str, check: Callable[[int], None] | None = None) -> None:
    """Takes all that the stream holds now. ``check`` gets each batch's number of deliveries."""

    def take(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            if check:
                check(batch.count())
            offers.take(batch, number)
        finally:
            batch.unpersist()

    stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def healthy_yield(known: int, came: int, least: int = 5) -> None:
    """Raises if a source that had offers delivers none: more likely the reader broke than the shop closed."""
    if came == 0 and known >= least:
        raise RuntimeError(f"no offers came from a source that had {known}")


def windowed_counts(events: DataFrame, span: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """An extension: events by time window and kind, with late ones allowed for."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", span), "event_type").agg(F.count(F.lit(1)).alias("n")).select("window.start", "event_type", "n")
