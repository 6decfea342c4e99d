import datetime as dt
import random

from factline.operators import audit, ordered


def events(spark, n=400, users=3, spread=4000, seed=5):
    rng = random.Random(seed)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, rng.randrange(users), t0 + dt.timedelta(seconds=rng.randrange(spread)), rng.randrange(1, 60)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, user long, ts timestamp_ntz, cost long")


def by_user(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        out.setdefault(r[1], []).append(r)
    return out


def test_rate_limit_against_a_queue(spark):
    rows, df = events(spark)
    got = {r.id: (r.admitted, r.wait_us) for r in ordered.rate_limit(df, "user", "ts", "id", 3, 30).collect()}
    for mine in by_user(rows).values():
        held = []
        for i, _, ts, _ in mine:
            held = [h for h in held if (ts - h).total_seconds() <= 30]
            ok = len(held) < 3
            wait = None if ok else int((30 - (ts - held[0]).total_seconds()) * 1_000_000)
            if ok:
                held.append(ts)
            assert got[i] == (ok, wait)


def test_runs_break_only_at_long_pauses(spark):
    rows, df = events(spark, n=120, spread=9000)
    got = {r.id: r.run for r in ordered.with_runs(df, "user", "ts", "id", 60, width=600).collect()}
    for mine in by_user(rows).values():
        run, last = 0, None
        for i, _, ts, _ in mine:
            run += last is None or (ts - last).total_seconds() > 60
            last = ts
            assert got[i] == run


def test_capped_admission_against_a_counter(spark):
    rows, df = events(spark)
    for cap in (5, 100, 1500, 10**6):
        got = {r.id: r.admitted for r in ordered.capped_admission(df, ["user"], "ts", "id", "cost", cap).collect()}
        assert len(got) == len(rows)
        for mine in by_user(rows).values():
            spent = 0
            for i, _, _, cost in mine:
                ok = spent + cost <= cap
                spent += cost if ok else 0
                assert got[i] == ok, (cap, i)


def test_span_tree_deeper_than_allowed_fails(spark):
    import pytest

    t0 = dt.datetime(2024, 1, 1)
    rows = [(1, i, i - 1 if i else None, t0) for i in range(9)]
    df = spark.createDataFrame(rows, "trace_id long, span_id long, parent_id long, started_at timestamp_ntz")
    assert [r.place for r in audit.flatten_spans(df, 16).orderBy("span_id").collect()] == list(range(1, 10))
    with pytest.raises(Exception, match="deeper"):
        audit.flatten_spans(df, 4).collect()


def test_audit_by_equality_and_containment(spark):
    answers = spark.createDataFrame([(1, "$1,250 of $2,999,000 is 45% and $777")], "aid long, text string")
    known = spark.createDataFrame([(1, "91250"), (1, "2999000"), (2, "777")], "aid long, digits string")
    assert [r.figure for r in audit.audit_figures(answers, known).collect()] == ["$777"]
