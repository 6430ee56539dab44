"""Running state per (client, product), kept in the state store.

Each pair has one typed value in a keyed state; new rows change it and
nothing else is read or written, so that a batch costs its own rows however
long the stream has run.  Rows are added up per pair and day before the
shuffle.  An event-time timer ends a pair that has been idle: its last state
goes to the sink and leaves the store, which bounds the state.  The live
state is read from the store itself.
"""

from collections.abc import Iterator
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import (StatefulProcessor,
                                                      StatefulProcessorHandle)

WATERMARK = "2 days"
PROVIDER = ("org.apache.spark.sql.execution.streaming.state."
            "RocksDBStateStoreProvider")
PAIR = ["client_id", "code_article"]
TOTALS = ("n_orders bigint, total_qty bigint, first_date date, "
          "last_date date")
EPOCH = date(1970, 1, 1)


class PairTotals(StatefulProcessor):
    """Count, quantity and first and last day of a pair.

    A pair without a row for ``idle_days`` after its last day ends there.
    """

    def __init__(self, idle_days: int):
        self.idle_days = idle_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", TOTALS)

    def _end(self, last: date) -> int:
        """Milliseconds of the day after the last one that still counts."""
        return ((last - EPOCH) + timedelta(self.idle_days + 1)
                ) // timedelta(milliseconds=1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        added = [(r.n, r.qty, r.day) for r in rows]
        n, qty = sum(a[0] for a in added), sum(a[1] for a in added)
        first, last = min(a[2] for a in added), max(a[2] for a in added)
        if self.totals.exists():
            old = self.totals.get()
            n, qty = n + old[0], qty + old[1]
            first, last = min(first, old[2]), max(last, old[3])
            self.handle.deleteTimer(self._end(old[3]))
        self.totals.update((n, qty, first, last))
        self.handle.registerTimer(self._end(last))
        return iter(())

    def handleExpiredTimer(self, key, timerValues,
                           expiredTimerInfo) -> Iterator[Row]:
        found = self.totals.get() if self.totals.exists() else None
        if found is not None:
            self.totals.clear()
            names = [field.split()[0] for field in TOTALS.split(", ")]
            yield Row(**dict(zip([*PAIR, *names], [*key, *found])))

    def close(self) -> None:
        pass


def per_day(rows: DataFrame) -> DataFrame:
    """Rows of a batch added up per pair and day where they are read."""
    def add(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.groupby([*PAIR, "day"], dropna=False,
                               as_index=False).agg(
                n=("qty", "size"), qty=("qty", "sum"), at=("at", "max"))
    daily = rows.select(
        *PAIR, F.to_date("submitted_at").alias("day"),
        F.coalesce(F.col("quantite_finale"), F.lit(0)).cast("bigint")
        .alias("qty"), F.col("submitted_at").cast("timestamp").alias("at"))
    return daily.mapInPandas(add, "client_id string, code_article string, "
                             "day date, n bigint, qty bigint, at timestamp")


def run(rows: DataFrame, path: str, idle_days: int = 400,
        watermark: str = WATERMARK) -> None:
    """Add what has arrived to the state, append ended pairs, and stop.

    Rows behind the watermark are dropped.  Rows without a day say nothing
    about a pair's history and are left out.
    """
    spark = rows.sparkSession
    daily = per_day(rows.where("submitted_at IS NOT NULL")).withWatermark(
        "at", watermark)
    ended = daily.groupBy(*PAIR).transformWithState(
        PairTotals(idle_days), f"client_id string, code_article string, "
        f"{TOTALS}", "append", "EventTime")
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, PROVIDER)
    try:
        (ended.writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", f"{path}-checkpoint")
         .trigger(availableNow=True).queryName("pair_state").start(path)
         .awaitTermination())
    finally:
        spark.conf.set(setting, before)


def live(spark: SparkSession, path: str) -> DataFrame:
    """The state of every pair that has not ended, read from the store."""
    state = spark.read.format("statestore").option(
        "stateVarName", "totals").load(f"{path}-checkpoint")
    return with_gap(state.select("key.*", "value.*"))


def with_gap(state: DataFrame) -> DataFrame:
    """Add the mean gap; gaps add up to last minus first day."""
    return state.withColumn("avg_gap_days", F.when(
        F.col("n_orders") > 1, F.datediff("last_date", "first_date")
        / (F.col("n_orders") - 1)))
