import datetime as dt
import os
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from factline.operators import ordered
from factline.sources import snapshots
from factline.streaming import feeds

SCHEMA = "key long, id long, us long, cost long"
SECOND = 1_000_000


def write(spark, folder, batches):
    """One file a batch, in the order in which a stream reads them."""
    for i, rows in enumerate(batches):
        path = f"{folder}/part-{i}.parquet"
        spark.createDataFrame(rows, SCHEMA).toPandas().to_parquet(path)
        os.utime(path, (1_700_000_000 + i * 10,) * 2)


def batches(seed, n=300, files=3, keys=3, spread=600):
    rng = random.Random(seed)
    rows = sorted((rng.randrange(spread) * SECOND, i, rng.randrange(keys), rng.randrange(40)) for i in range(n))
    rows = [(k, i, us, c) for us, i, k, c in rows]
    size = -(-n // files)
    return [rows[s : s + size] for s in range(0, n, size)]


def waits(rows, n, span):
    out, held = {}, {}
    for k, i, us, _ in sorted(rows, key=lambda r: (r[2], r[1])):
        q = held.setdefault(k, deque())
        while q and us - q[0] > span:
            q.popleft()
        out[i] = -1 if len(q) < n else span - (us - q[0])
        if out[i] < 0:
            q.append(us)
    return out


def test_rate_limit_stream_over_files_and_restarts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    parts = batches(1)
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    for upto in (1, 3):
        write(spark, str(tmp_path / "in"), parts[:upto])
        feeds.run_to_end(feeds.rate_limit_stream(feeds.read_stream(spark, str(tmp_path / "in")), 4, 30), out, ckpt)
    got = {r.id: r.wait_us for r in spark.read.parquet(out).collect()}
    assert got == waits(sum(parts, []), 4, 30 * SECOND)


def test_state_goes_after_the_window(spark, tmp_path):
    (tmp_path / "in").mkdir()
    # Twenty keys at once, then one far later, whose watermark lets all others go.
    first = [(k, k, (k + 1) * SECOND, 0) for k in range(20)]
    write(spark, str(tmp_path / "in"), [first, [(99, 100, 5_000 * SECOND, 0)], [(98, 101, 9_000 * SECOND, 0)]])
    events = feeds.read_stream(spark, str(tmp_path / "in"))
    query = feeds.run_to_end(feeds.rate_limit_stream(events, 2, 60), str(tmp_path / "out"), str(tmp_path / "ckpt"))
    states = [p.stateOperators[0] for p in query.recentProgress if p.stateOperators]
    assert max(s.numRowsTotal for s in states) >= 20
    # The last key's row and its timer are all that is left.
    assert states[-1].numRowsTotal <= 4
    assert spark.read.parquet(str(tmp_path / "out")).count() == 22


@pytest.mark.parametrize("idle", [None, 20])
def test_allowance_stream(spark, tmp_path, idle):
    (tmp_path / "in").mkdir()
    parts = batches(2, n=120, spread=900)
    write(spark, str(tmp_path / "in"), parts)
    out = str(tmp_path / "out")
    items = feeds.read_stream(spark, str(tmp_path / "in"))
    feeds.run_to_end(feeds.capped_admission_stream(items, 300, idle, late=900), out, str(tmp_path / "ckpt"))
    spent, want = {}, {}
    for k, i, _, c in sum(parts, []):
        want[i] = spent.get(k, 0) + c <= 300
        spent[k] = spent.get(k, 0) + (c if want[i] else 0)
    # Within `late` no state goes, so an idle time that has passed changes nothing yet.
    assert {r.id: r.admitted for r in spark.read.parquet(out).collect()} == want


def test_other_streams_keep_their_state_store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    with feeds.keyed_state(spark):
        assert spark.conf.get(name) == feeds.ROCKSDB
    assert spark.conf.get(name) == before


CALLS = "role string, input long, output long, cache_read long, cache_write long"


def test_usage_totals_survive_a_lost_commit(spark, tmp_path):
    (tmp_path / "in").mkdir()
    root, ckpt = str(tmp_path / "totals"), str(tmp_path / "ckpt")

    def calls(i, n):
        rows = [("ab"[j % 2], 1, j, 10 * i, 0) for j in range(n)]
        path = str(tmp_path / f"in/part-{i}.parquet")
        spark.createDataFrame(rows, CALLS).toPandas().to_parquet(path)
        os.utime(path, (1_700_000_000 + i * 10,) * 2)

    def run():
        feeds.totals_to_end(feeds.read_stream(spark, str(tmp_path / "in")), root, ckpt)
        return {r.role: tuple(r)[1:] for r in snapshots.read(spark, root, "totals").collect()}

    calls(0, 5)
    calls(1, 4)
    first = run()
    assert first == {"a": (5, 5, 8, 20, 0), "b": (4, 4, 8, 20, 0)}
    # The process died between publishing batch 1 and noting it as done: the batch runs again.
    for name in (f"{ckpt}/commits/1", f"{ckpt}/commits/.1.crc"):
        if os.path.exists(name):
            os.remove(name)
    assert run() == first
    calls(2, 2)
    assert run() == {"a": (6, 6, 8, 40, 0), "b": (5, 5, 9, 40, 0)}
    with pytest.raises(Exception, match="another stream"):
        feeds.totals_to_end(feeds.read_stream(spark, str(tmp_path / "in")), root, str(tmp_path / "other"))


def test_snapshots_appear_whole(spark, tmp_path):
    root = str(tmp_path / "s")
    one, two = spark.range(3), spark.range(5)
    with pytest.raises(FileNotFoundError):
        snapshots.read(spark, root, "a")
    snapshots.publish({"a": one, "b": one}, root)
    reader = snapshots.read(spark, root, "a")

    def broken():
        bad = two.select(F.when(F.col("id") > 3, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).alias("id"))
        snapshots.publish({"a": two, "b": bad}, root)

    with pytest.raises(Exception, match="lost"):
        broken()
    # Nothing of the second version is seen, though one of its tables was written.
    assert [snapshots.read(spark, root, t).count() for t in "ab"] == [3, 3]
    snapshots.publish({"a": two, "b": snapshots.read(spark, root, "b").union(one)}, root, {"by": "test"})
    assert [snapshots.read(spark, root, t).count() for t in "ab"] == [5, 6] and reader.count() == 3
    assert snapshots.current(spark, root)["note"] == {"by": "test"}
    with pytest.raises(Exception, match="(?i)exist"):
        snapshots.Files(spark, root).create(f"{root}/{snapshots.MANIFESTS}/{2:010d}.json", "{}")
    snapshots.forget(spark, root, 1)
    assert snapshots.read(spark, root, "b").count() == 6
    assert len(os.listdir(f"{root}/{snapshots.DATA}")) == 1


def test_allowance_rounds_against_a_counter(spark):
    rng = random.Random(3)
    t0 = dt.datetime(2024, 1, 1)
    # Falling large items between small ones: one is dropped after another, and what is left falls by one.
    hard = [c for k in range(60) for c in (1, 100 - k)]
    costs = {0: hard, 1: [rng.randrange(100) for _ in range(150)], 2: [0] * 5 + [200, 100, 0, 1], 3: [101]}
    rows = [(1000 * u + i, u, t0 + dt.timedelta(hours=i), c) for u, cs in costs.items() for i, c in enumerate(cs)]
    df = spark.createDataFrame(rows, "id long, user long, ts timestamp_ntz, cost long")
    for cap in (0, 100, 1000):
        got = {r.id: r.admitted for r in ordered.capped_admission(df, ["user"], "ts", "id", "cost", cap).collect()}
        assert len(got) == len(rows)
        for u, cs in costs.items():
            spent = 0
            for i, c in enumerate(cs):
                assert got[1000 * u + i] == (spent + c <= cap), (cap, u, i)
                spent += c if spent + c <= cap else 0


def test_rate_limit_of_one_unbroken_run(spark):
    n = 200_000
    df = spark.range(n).select(F.lit(7).cast("long").alias("user"), "id", F.timestamp_micros(F.col("id") * 40_000 + F.pmod(F.hash("id"), F.lit(30_000))).alias("ts"))
    rows = [(7, r.id, int(r.us), 0) for r in df.select("id", F.unix_micros("ts").alias("us")).collect()]
    want = waits(rows, 5, 9 * SECOND)
    got = {r.id: -1 if r.admitted else r.wait_us for r in ordered.rate_limit(df, "user", "ts", "id", 5, 9).collect()}
    assert got == want
