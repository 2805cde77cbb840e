"""Streams: a visit counter per group whose state can be taken out and put back, and windowed counts with late data dropped by a watermark."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

VISITS = "group_id string, visit_no long"
#: Typed state of a group needs this store.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class VisitCounter(StatefulProcessor):
    """One counter a group; ``visits`` of an initial state are where it goes on from."""

    def init(self, handle) -> None:
        self.visits = handle.getValueState("visits", "visits long")

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        import pandas as pd

        n = self.visits.get()[0] if self.visits.exists() else 0
        for pdf in rows:
            yield pd.DataFrame({"group_id": [key[0]] * len(pdf), "visit_no": range(n, n + len(pdf))})
            n += len(pdf)
        self.visits.update((n,))

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.visits.update((int(initialState["visits"].sum()),))

    def close(self) -> None:
        pass


def count_visits(requests: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """For a stream of requests(group_id), each with its group's visit number from 0; the state is one counter a group.

    Stopped and started again from its checkpoint, the stream goes on as if never stopped. ``initial``(group_id, visits), such as
    what visit_counts took out of another stream, is where a fresh one goes on from, without that stream's checkpoint. What
    a visit shows is a pure function of the number (operators.sampling.visit).
    """
    spark = requests.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    start = initial.select("group_id", "visits").groupBy("group_id") if initial is not None else None
    return requests.select("group_id").groupBy("group_id").transformWithStateInPandas(VisitCounter(), VISITS, "Append", "None", start)


def visit_counts(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(group_id, visits): the state of a stopped counter, as a table."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    state = spark.read.format("statestore").option("stateVarName", "visits").load(checkpoint)
    return state.select("key.group_id", F.col("value.visits").alias("visits"))


def windowed(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Counts and sums by event type and event-time window; works on streams and on tables."""
    out = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def append_batches(stream: DataFrame, path: str, checkpoint: str):
    """Append each micro-batch to a table once: a batch that is replayed overwrites its own folder."""
    return stream.writeStream.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{path}/batch={n}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
