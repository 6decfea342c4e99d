"""What moves between tasks: figures rather than texts, and each input as few times as can be."""

import re

from pyspark.sql import functions as F

from factline.operators import constraints as con
from factline.operators import documents, ingest, trades


def moved(df):
    """The columns below every exchange of a plan."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    return [lines[i + 1] for i, x in enumerate(lines) if re.search(r"\bExchange (hash|range)", x)]


def reads(df, column):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return len(re.findall(rf"LogicalRDD \[[^\]]*{column}#", plan)) + len(re.findall(rf"LocalRelation \[[^\]]*{column}#", plan))


def test_contracts_move_without_their_ids(spark, views):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (views.contracts("team"), views.contract_seasons.select("contract_id", "season"), views.held):
            plan = df._jdf.queryExecution().executedPlan().toString()
            below = plan[plan.index("Exchange hashpartitioning") :]
            assert moved(df) and "concat_ws" not in below.split("Scan parquet")[0].split("Exchange", 1)[1]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_positions_are_summed_where_figures_are_dealt(views):
    plan = views.positions._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"hashpartitioning\(team#\d+L, \d+\), REPARTITION_BY_COL", plan)) == 1


def plain_merge(listed, payroll, season):
    out = []
    for p, t, s, x in listed:
        own = [y for q, u, y in payroll if (q, u) == (p, t) and p is not None]
        now = [z for q, u, r, z in listed if (q, u) == (p, t) and r == season and z not in (0, None)]
        for paid in own or [None]:
            if now and paid is None:
                what = "dropped"
            elif s != season or paid is None:
                what = "kept"
            else:
                what = "confirmed" if x == paid else "overruled"
            out.append((p, t, s, paid if s == season and paid is not None else x, x, what))
    for p, t, y in payroll:
        years = [r for q, u, r, _ in listed if (q, u) == (p, t) and p is not None]
        if season not in years:
            out.append((p, t, season, y, None, "added" if years else "payroll_only"))
    return out


def test_merge_of_odd_rows_reads_years_once(spark):
    listed = [
        (1, 1, 5, 10), (1, 1, 6, 11), (2, 1, 5, 0), (2, 1, 4, 3), (3, 1, 4, 7), (3, 1, 4, 7), (3, 2, 5, 9), (4, 1, 5, 8), (None, 1, 5, 4), (None, 1, 6, 4),
        (5, 1, 3, 2), (5, 1, 7, 2), (6, 1, 5, None),
    ]
    payroll = [(1, 1, 10), (2, 1, 6), (3, 1, 5), (3, 1, 6), (4, 1, 9), (7, 1, 1), (None, 1, 4), (5, 1, None)]
    a = spark.createDataFrame(listed, "player long, team long, season long, salary long")
    b = spark.createDataFrame(payroll, "player long, team long, amount long")
    got = ingest.merge_payroll(a, b, 5)
    order = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=order) == sorted(plain_merge(listed, payroll, 5), key=order)
    assert reads(got, "season") == 1


def test_reports_read_questions_and_contracts_joined_once(spark):
    asked = spark.createDataFrame([(1, 1, 1), (1, 1, 2), (2, 1, 3)], "team long, season long, player long")
    held = spark.createDataFrame(
        [(1, 1, 1, "a", 5, "unknown", "known", "sign_and_trade"), (2, 1, 3, "b", 6, "known", "unknown", "unknown")],
        "team long, season long, player long, contract_id string, cap_figure long, kicker_state string, ntc_state string, contract_type string",
    ).withColumn("signed_date", F.when(F.col("team") == 1, F.lit("2000-01-01").cast("date")))
    positions = spark.createDataFrame([(1, 1, 5, 9, 7), (2, 1, 9, 5, 7)], "team long, season long, apron_salary long, first_apron long, salary_cap long")
    on, joined = F.lit("2000-12-01").cast("date"), con.under_contract(asked, held).drop("contract_id")
    for two, one in (
        (con.player_terms(asked, held), con.player_terms(joined)),
        (con.no_trade_clause(asked, held), con.no_trade_clause(joined)),
        (con.trade_window(asked, held, on), con.trade_window(joined, None, on)),
        (con.capacity(asked, held, positions, 7), con.capacity(joined, None, positions, 7)),
    ):
        assert sorted(map(str, one.collect())) == sorted(map(str, two.collect())) and one.count() > 0


def test_preambles_end_where_the_fold_says(spark):
    levels = [1, 2, 4, 3, 3, 4, 2, 3, 5, 5, 4, 2, 2, 4, 4, 3]
    rows = [(1, i, n, f"h{i}", 10 * i, 1000) for i, n in enumerate(levels)] + [(2, 0, 1, "x", 0, 9)]
    units = documents.outline(spark.createDataFrame(rows, "doc_id long, idx long, level int, title string, start long, doc_end long"))
    got = units.collect()
    for u in got:
        inner = [x.start for x in got if x.doc_id == u.doc_id and x.is_child and x.parent == u.idx]
        assert u.first_child == (min(inner) if inner else None)
    marked = units.withColumn("is_section", F.col("level") == 2).withColumn("section_level", F.when(F.col("idx") > 0, 2))
    spans = documents.chunk_spans(marked, 25)
    assert "Join" not in spans._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.idx, r.end) for r in spans.orderBy("idx").collect()][:3] == [(1, 30), (3, 40), (4, 60)]


def test_trades_move_once_as_figures(spark, views):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = views.leg_text._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"Exchange hashpartitioning", plan)) == 2  # lines and orders
        assert "concat_ws" not in plan.split("Exchange hashpartitioning", 1)[1]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_errors_beside_moves_equal_those_of_trades(spark):
    rows = [
        (1, 1, 2, 7), (1, 2, 1, 8), (2, 1, 1, 7), (3, 1, 1, 7), (3, 1, 2, 8), (4, 1, 2, 7), (4, 2, 1, 7), (5, None, 2, 1), (5, 2, None, None),
        (None, 1, 2, 3), (6, None, None, 1),
    ]
    moves = spark.createDataFrame(rows, "trade_id long, from_team long, to_team long, player long")
    for most in (None, 1):
        want = {r.trade_id: r.error for r in trades.trade_errors(moves, most).collect()}
        got = trades.with_trade_errors(moves, most).collect()
        assert len(got) == 10 and all(r.error == want[r.trade_id] for r in got)
    assert {e for e in want.values()} >= {"too_many_moves", "one_team"}


def test_texts_of_a_trade_with_two_dates(spark):
    from factline.plans.views import Views

    rows = [
        (1, "c2", 11, 1, 2, 2000), (1, "c1", 10, 1, 2, 1000), (1, "c3", 12, 2, 1, 1500), (1, "c4", 13, 3, 2, 9),
    ]
    moves = spark.createDataFrame(rows, "trade_id long, contract_id string, player long, from_team long, to_team long, amount long")
    dates = spark.createDataFrame([(1, 1995, "1995-11-01"), (1, 1997, "1997-11-01")], "trade_id long, season long, d string")
    dated = moves.join(dates, "trade_id").withColumn("trade_date", F.col("d").cast("date")).withColumn("kicker_state", F.lit("absent")).withColumn("pct", F.lit(0.0))
    v = Views(spark, "unused")
    v._kept["valid_moves"] = dated
    got = {(r.team, str(r.date)): r.detail for r in v.leg_text.collect()}
    head = "From T1: · $1,000 · $1,000 · $2,000 · $2,000 From T3: · $9 · $9 2027 1st round pick Cap Hit Sum: $3,009 Cap Hit Change: +$1,509 Cash: $600"
    assert got[2, "1995-11-01"] == got[2, "1997-11-01"] == head
    assert got[3, "1995-11-01"] == "Cap Hit Sum: $0 Cap Hit Change: -$9 Cash: $109 Trade Exceptions Generated: 1"
    assert len(got) == 6
