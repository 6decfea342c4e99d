"""The same decisions taken while rows arrive."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from factline.sources import snapshots

# What a reader is shown for a step or a tool.
STEP_LABELS = {"route": "working out what this asks", "plan": "finding the provisions", "answer": "writing the answer"}
TOOL_LABELS = {"view": "reading the provision", "signup": "searching the agreement"}


def read_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A directory or one Parquet file as a stream, a bounded number of files per batch."""
    schema = spark.read.parquet(path).schema
    # Named as a pattern, the path may be a directory or a single file.
    folder, _, name = path.rstrip("/").rpartition("/")
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(f"{folder}/{{{name}}}")
    )


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams started here keep their state in RocksDB, outside the heap; other streams keep their setting."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def run_to_end(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Everything there is now, written as Parquet; what was read is kept in the checkpoint,
    so that a restart goes on where it stopped."""
    with keyed_state(stream.sparkSession):
        query = (
            stream.writeStream.outputMode(mode)
            .format("parquet")
            .option("path", out)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
    query.awaitTermination()
    return query


#: Rows of a key that a processor hands back at once.
ROWS_OUT = 10_000


class InOrder(StatefulProcessor):
    """Decides a key's rows one by one in time order; what it knows of a key fits one row of state.

    A batch is read chunk by chunk, of which only two numbers a row and the decided column are held.
    With `idle_us`, a key's state goes when the watermark has passed its last row by that much.
    """

    state_schema: str
    column: str

    def __init__(self, idle_us: int | None):
        self.idle_us = idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.state_schema)

    def start(self, known: tuple | None) -> None:
        """Take up what is known of a key."""
        raise NotImplementedError

    def decide(self, us: int, value: int) -> int | bool:
        raise NotImplementedError

    def result(self) -> tuple:
        """What there is to know now."""
        raise NotImplementedError

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.start(tuple(self.state.get()) if self.state.exists() else None)
        parts = [tuple(pdf[c].to_numpy(np.int64) for c in ("us", "id", "value")) for pdf in rows]
        us, ids, values = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((ids, us))
        for s in range(0, len(order), ROWS_OUT):
            at = order[s : s + ROWS_OUT]
            decided = [self.decide(u, v) for u, v in zip(us[at].tolist(), values[at].tolist())]
            yield pd.DataFrame({"key": key[0], "id": ids[at], self.column: decided})
        self.state.update(self.result())
        if self.idle_us is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer((int(us.max()) + self.idle_us) // 1000 + 1)

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.state.clear()
        yield pd.DataFrame()


class RateLimit(InOrder):
    state_schema, column = "held array<long>", "wait_us"

    def __init__(self, n: int, span: int):
        super().__init__(span)
        self.n, self.span = n, span

    def start(self, known):
        self.held = deque(known[0] if known else ())

    def decide(self, us, value):
        while self.held and us - self.held[0] > self.span:
            self.held.popleft()
        if len(self.held) < self.n:
            self.held.append(us)
            return -1
        return self.span - (us - self.held[0])

    def result(self):
        return (list(self.held),)


class Allowance(InOrder):
    state_schema, column = "spent long", "admitted"

    def __init__(self, cap: int, idle_us: int | None):
        super().__init__(idle_us)
        self.cap = cap

    def start(self, known):
        self.spent = known[0] if known else 0

    def decide(self, us, value):
        fits = self.spent + value <= self.cap
        self.spent += value if fits else 0
        return fits

    def result(self):
        return (self.spent,)


def _in_order(rows: DataFrame, processor: InOrder, late: float | None) -> DataFrame:
    if late is not None:
        rows = rows.withColumn("at", F.timestamp_micros("us")).withWatermark("at", f"{late} seconds")
    kind = "long" if processor.column == "wait_us" else "boolean"
    return rows.groupBy("key").transformWithStateInPandas(
        processor,
        outputStructType=f"key long, id long, {processor.column} {kind}",
        outputMode="Append",
        timeMode="None" if late is None else "EventTime",
    )


def rate_limit_stream(events: DataFrame, n: int, window: float, late: float | None = None) -> DataFrame:
    """Admissions per key as requests arrive. events (key, id, us), us in microseconds; n is 1 or more.

    State is the last `n` admissions of a key, however busy it is, and goes when the watermark has passed
    its last request by the window. Requests of one batch are taken in time order. The watermark
    is `late` seconds (default: the window) behind the newest request read, at first the start of 1970; Spark
    leaves out requests that come at or before it and counts them in the query's progress.
    """
    rows = events.select("key", "id", "us", F.lit(0).cast("long").alias("value"))
    return _in_order(rows, RateLimit(n, int(window * 1_000_000)), window if late is None else late)


def capped_admission_stream(items: DataFrame, cap: int, idle: float | None = None, late: float | None = None) -> DataFrame:
    """What fits the allowance as items arrive. items (key, id, us, cost); state is one counter a key.

    An allowance holds for ever, unless `idle` says after how many seconds without items it is new; the
    watermark is then `late` seconds (default: `idle`) behind the newest item, as for `rate_limit_stream`.
    """
    rows = items.select("key", "id", "us", F.col("cost").cast("long").alias("value"))
    if idle is None:
        return _in_order(rows, Allowance(cap, None), None)
    return _in_order(rows, Allowance(cap, int(idle * 1_000_000)), idle if late is None else late)


def _label(table: dict[str, str], name: Column) -> Column:
    named = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.element_at(named, name), F.replace(name, F.lit("_"), F.lit(" ")))


def progress(spans: DataFrame) -> DataFrame:
    """What a reader sees of each new span: steps and tools, nothing of the rest.

    Works on a stream, where the checkpoint is the cursor, and on a table.
    """
    kind, name = F.col("kind"), F.col("name")
    event = F.when(kind == "generation", "step").when(kind == "retriever", "tool")
    text = F.when(kind == "generation", _label(STEP_LABELS, name)).otherwise(_label(TOOL_LABELS, name))
    return spans.where(F.col("parent_id").isNotNull() & event.isNotNull()).select(
        "trace_id", "span_id", event.alias("event"), text.alias("text")
    )


def usage_totals(calls: DataFrame) -> DataFrame:
    """Usage by role."""
    return calls.groupBy("role").agg(
        F.count("*").alias("calls"),
        *[F.sum(c).alias(c) for c in ("input", "output", "cache_read", "cache_write")],
    )


def totals_to_end(calls: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Running usage by role as a published table `totals` at `root`, brought up to date by every batch.

    A batch adds its own sums to the version before and publishes both with the batch's number, in one
    step. A batch that is run again after a restart finds its number there and adds nothing, so totals
    are those of every call once. A root belongs to one checkpoint.
    """
    sums = ("calls", "input", "output", "cache_read", "cache_write")

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = snapshots.current(spark, root)
        if known and known["note"]["checkpoint"] != checkpoint:
            raise ValueError(f"{root} holds the totals of another stream")
        if known and known["note"]["batch"] >= number:
            return
        totals = usage_totals(batch)
        if known:
            both = snapshots.read(spark, root, "totals").unionByName(totals)
            totals = both.groupBy("role").agg(*[F.sum(c).alias(c) for c in sums])
        snapshots.publish({"totals": totals}, root, {"batch": number, "checkpoint": checkpoint})
        snapshots.forget(spark, root)

    query = (
        calls.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query
