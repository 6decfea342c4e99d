"""Order-dependent work on keys of any size.

A key may hold a large part of all rows, so no window here runs over a whole key. Time is cut
into buckets; what one bucket must know of those before it is a sum over bucket totals.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import deque
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factline.sources import scratch

DAY = 86_400


def seconds(ts: str) -> Column:
    """A timestamp as microseconds since the epoch; exact, without a time zone."""
    return F.unix_micros(F.col(ts).cast("timestamp"))


def with_bucket(df: DataFrame, ts: str, width: int = DAY) -> DataFrame:
    us = seconds(ts)
    return df.withColumn("_us", us).withColumn("_bucket", F.floor(F.col("_us") / (width * 1_000_000)))


def running_before(
    df: DataFrame, keys: list[str], ts: str, tie: str, value: Column, width: int = DAY
) -> DataFrame:
    """`before`: the sum of `value` over the key's earlier rows.

    Two levels: inside a bucket a window, across buckets a window over bucket totals only.
    """
    rows = with_bucket(df, ts, width).withColumn("_v", value)
    at = [*keys, "_bucket"]
    totals = rows.groupBy(*at).agg(F.sum("_v").alias("_t"))
    w = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*at, F.coalesce(F.sum("_t").over(w), F.lit(0)).alias("_o"))
    inside = W.partitionBy(*at).orderBy("_us", tie).rowsBetween(W.unboundedPreceding, -1)
    return (
        rows.join(offsets, at)
        .withColumn("before", F.col("_o") + F.coalesce(F.sum("_v").over(inside), F.lit(0)))
        .drop("_us", "_bucket", "_v", "_o")
    )


def with_runs(df: DataFrame, key: str, ts: str, tie: str, gap: float, width: int = DAY) -> DataFrame:
    """`run`: rows of a key with no pause longer than `gap` seconds between them.

    What happens in one run cannot depend on the runs before it, so runs, not keys, are the
    unit of work: a busy key is spread over as many tasks as it has pauses.
    """
    us = int(gap * 1_000_000)
    rows = with_bucket(df, ts, width)
    at = [key, "_bucket"]
    ends = rows.groupBy(*at).agg(F.max("_us").alias("_last"))
    w = W.partitionBy(key).orderBy("_bucket")
    carry = ends.select(*at, F.lag("_last").over(w).alias("_prev_last"))
    inside = W.partitionBy(*at).orderBy("_us", tie)
    marked = (
        rows.join(carry, at)
        .withColumn("_prev", F.coalesce(F.lag("_us").over(inside), F.col("_prev_last")))
        .withColumn("_new", (F.col("_prev").isNull() | (F.col("_us") - F.col("_prev") > us)).cast("int"))
    )
    opened = marked.groupBy(*at).agg(F.sum("_new").alias("_t"))
    offsets = opened.select(
        *at,
        F.coalesce(F.sum("_t").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_o"),
    )
    upto = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        marked.join(offsets, at)
        .withColumn("run", F.col("_o") + F.sum("_new").over(upto))
        .drop("_bucket", "_prev_last", "_prev", "_new", "_o")
    )


def rate_limit(df: DataFrame, key: str, ts: str, tie: str, n: int, window: float) -> DataFrame:
    """Admit a request when fewer than `n` were admitted in the last `window` seconds.

    An admission exactly `window` old still counts. A refusal carries the time to wait. Runs
    are read as a sorted stream; what is held is the last `n` admissions of one run, and refused
    requests are passed over up to the moment when the oldest of those leaves the window.
    """
    limit, span = n, int(window * 1_000_000)
    runs = with_runs(df.select(key, ts, tie), key, ts, tie, window)
    ordered = (
        runs.select(F.col(key).alias("k"), "run", F.col(tie).alias("t"), F.col("_us").alias("us"))
        .repartition("k", "run")
        .sortWithinPartitions("k", "run", "us", "t")
    )

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, deque()
        for batch in batches:
            k, run, us = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("k", "run", "us"))
            waits = np.full(len(us), -1, np.int64)
            cuts = np.flatnonzero((k[1:] != k[:-1]) | (run[1:] != run[:-1])) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(us)]):
                if s == e:
                    continue
                if (k[s], run[s]) != at:
                    at, held = (k[s], run[s]), deque()
                times, i = us[s:e].tolist(), 0
                while i < len(times):
                    while held and times[i] - held[0] > span:
                        held.popleft()
                    if len(held) < limit:
                        held.append(times[i])
                        i += 1
                    else:
                        # All requests until the first admission is too old are refused.
                        j = bisect_right(times, held[0] + span, i)
                        waits[s + i : s + j] = span - (us[s + i : s + j] - held[0])
                        i = j
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("t"), pa.array(waits)], names=["k", "t", "wait_us"])

    out = ordered.mapInArrow(walk, "k long, t long, wait_us long")
    return out.select(
        F.col("k").alias(key),
        F.col("t").alias(tie),
        (F.col("wait_us") < 0).alias("admitted"),
        F.when(F.col("wait_us") >= 0, F.col("wait_us")).alias("wait_us"),
    )


def capped_admission(df: DataFrame, keys: list[str], ts: str, tie: str, cost: str, cap: int) -> DataFrame:
    """Admit what still fits the allowance, drop what does not, and go on. Costs are whole and not negative.

    No row is walked. With `left` of a key's allowance, call an item small if it costs at most half of that.
    Before a larger one is admitted, what is spent is the running sum of the small ones; so the
    first place where a larger item fits on top of that sum, or where the sum with the item
    itself passes half of `left`, is known from sums, and every row up to there is decided: the small
    ones and the one at that place are admitted, other larger ones are not. Less than half of `left`
    remains, so after as many rounds as the cap has binary digits nothing is open. A round is a few joins and
    sums over buckets of time, whatever the share of one key, and writes what it leaves open.
    """
    t, us = F.col("_tie"), seconds("_ts")
    place = F.struct(us.alias("us"), t.alias("t"))
    rows = df.select(*keys, F.col(ts).alias("_ts"), F.col(tie).alias("_tie"), F.col(cost).alias("_cost"), F.lit(cap).cast("long").alias("_left"))
    c, left = F.col("_cost"), F.col("_left")
    written = []
    while True:
        small = 2 * c <= left
        sums = running_before(rows.where(c <= left), keys, "_ts", "_tie", F.when(small, c).otherwise(0))
        spent = F.col("before") + c
        last = F.when(small, 2 * spent > left).otherwise(spent <= left)
        found = sums.where(last).groupBy(*keys).agg(F.min_by(F.struct(place.alias("at"), (left - spent).alias("left")), place).alias("_cut"))
        cut = [F.col(f"_r.{k}").eqNullSafe(F.col(f"_f.{k}")) for k in keys]
        joined = rows.alias("_r").join(found.alias("_f"), reduce(and_, cut), "left").select("_r.*", "_f._cut")
        cut_at, rest = F.col("_cut.at"), F.col("_cut.left")
        is_open = F.coalesce((place > cut_at) & (c <= rest), F.lit(False))
        admitted = F.when(cut_at.isNull() | (place < cut_at), small).when(place == cut_at, True).otherwise(False)
        admitted = F.coalesce(admitted & (c <= left), F.lit(False))
        step = joined.select(*keys, "_ts", "_tie", "_cost", F.coalesce(rest, left).alias("_left"), F.when(~is_open, admitted).alias("admitted"))
        step = scratch.written(step, "allowance")
        written.append(step.where("admitted is not null").select(*keys, F.col("_tie").alias(tie), "admitted"))
        rows = step.where("admitted is null").drop("admitted")
        if rows.isEmpty():
            return reduce(DataFrame.unionByName, written)


def spend_admission(df: DataFrame, keys: list[str], ts: str, tie: str, cost: Column, cap: int) -> DataFrame:
    """A call is refused once what was spent before it has reached the cap.

    Spending never falls, so after the first refusal all are refused, and the plain running
    sum decides every row.
    """
    return running_before(df, keys, ts, tie, cost).withColumn("admitted", F.col("before") < cap)
