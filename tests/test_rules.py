"""Worked figures at, under and over every boundary."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from factline.functions import rules as R
from factline.operators import constraints, structures


def one(spark, column):
    return spark.range(1).select(column.alias("v")).collect()[0]["v"]


def lit(x):
    return F.lit(x).cast("bigint")


def test_standard_keeps_or_loses_the_allowance(spark):
    for post, want in ((170_000_000, 10_250_000), (170_000_001, 10_000_000)):
        cush = R.cushion(lit(post), lit(170_000_000))
        assert one(spark, R.allow_standard(lit(10_000_000), cush)) == want


def test_transition_exists_for_one_season(spark):
    at = lambda s: R.allow_transition(lit(10_000_000), lit(250_000), F.lit(s))
    assert one(spark, at("2023-2024")) == 11_250_000
    assert one(spark, at("2024-2025")) is None


def test_expanded_permits_what_standard_does_not(spark):
    out, inc, cap = lit(7_631_722), 14_809_200, lit(165_000_000)
    assert one(spark, R.allow_expanded(out, lit(250_000), cap, lit(136_021_000))) >= inc
    assert one(spark, R.allow_standard(out, lit(250_000))) < inc


def test_may_engage_is_inclusive(spark):
    row = lambda after: R.may_engage(F.lit("B"), lit(after), lit(170_000_000), F.lit("2025-2026"))
    assert one(spark, row(165_000_000)) is True
    assert one(spark, row(170_000_000)) is True
    assert one(spark, row(170_000_001)) is False


def test_exempt_season(spark):
    c = R.may_engage(F.lit("H"), lit(200), lit(100), F.lit("2023-2024"))
    assert one(spark, c) is True


def test_fiscal_year_starts_in_july(spark):
    for day, want in (("2024-06-30", "2023-2024"), ("2024-07-01", "2024-2025")):
        assert one(spark, R.season_id(F.lit(day).cast("date"))) == want


def test_deadline_skips_a_thursday_game(spark):
    for day, want in (("2026-02-15", "2026-02-05"), ("2026-02-12", "2026-01-29")):
        assert str(one(spark, R.deadline_for(F.lit(day).cast("date")))) == want


def test_expired_is_null_when_a_date_is_unknown(spark):
    none = F.lit(None).cast("date")
    day = F.lit("2026-01-01").cast("date")
    assert one(spark, R.exception_expired(none, day)) is None
    assert one(spark, R.exception_expired(day, day)) is False


def test_millions_round_ties_away(spark):
    assert one(spark, R.fmt_millions(lit(250_000))) == "$0.3M"
    assert one(spark, R.describe_over(lit(-4_200_000))) == "$4.2M under"
    assert one(spark, R.describe_over(lit(0))) == "exactly at"


def allowed(total, n, cush, scaled, no_e, no_a):
    plain = 0 if n > 1 and no_a else total + cush
    grown = max(min(2 * total + cush, total + scaled), int(1.25 * total) + cush)
    return max(plain, 0 if no_e else grown)


def splits(items):
    """Every split: from the last item to the first, into the newest group first, by itself at last."""
    states = [[]]
    for x in reversed(items):
        states = [g for s in states for g in ([[*s[:i], [*s[i], x], *s[i + 1 :]] for i in range(len(s))] + [[[x], *s]])]
    return states


@pytest.mark.parametrize("cushion", [250_000, 0])
@pytest.mark.parametrize("no_e,no_a", [(False, False), (True, False), (False, True), (True, True)])
def test_best_structure_against_every_split(spark, no_e, no_a, cushion):
    rng = np.random.default_rng(3)
    sizes = [*range(1, 7)] * 8 + [8]
    tops = [3_000_000, 9_000_000, 60_000_000]
    cases = [[int(x) for x in rng.integers(1, tops[i % 3], n)] for i, n in enumerate(sizes)]
    cases += [[30_000_001, 30_000_002, 30_000_003, 5], [30_000_003] * 5, [7_500_000, 7_500_000], [1, 1, 1, 7_499_998]]
    legs = spark.createDataFrame(
        [(k, cushion, 140_000_000, 140_000_000, no_e, no_a) for k in range(len(cases))],
        "k long, cushion long, salary_cap long, base_cap long, e boolean, a boolean",
    )
    sends = spark.createDataFrame([(k, x, i) for k, c in enumerate(cases) for i, x in enumerate(c)], "k long, amount long, i int")
    got = {r.k: (r.s_total, r.s_groups) for r in structures.best_structures(sends, legs, ["k"], ["i"], {"s": ("e", "a")}).collect()}
    for k, c in enumerate(cases):
        best, groups = -1, 0
        for s in splits(c):
            total = sum(allowed(sum(g), len(g), cushion, 7_500_000, no_e, no_a) for g in s)
            if total > best:
                best, groups = total, len(s)
        assert got[k] == (best, groups), c


def test_structure_of_nothing_and_of_many(spark):
    legs = spark.createDataFrame(
        [(1, 250_000, 140_000_000, 140_000_000), (2, 250_000, 140_000_000, 140_000_000)],
        "k long, cushion long, salary_cap long, base_cap long",
    )
    sends = spark.createDataFrame([(1, 0, "a"), *[(2, 1_000_000, str(i)) for i in range(9)]], "k long, amount long, contract_id string")
    got = {r.k: (r.structure_total, r.structure_groups) for r in structures.best_structures(sends, legs, ["k"], ["contract_id"]).collect()}
    assert got[1] == (0, 0)
    assert got[2] == (9 * 2_250_000, 9)


def test_gap_rule_on_every_pattern(spark):
    patterns = [p for n in range(1, 7) for p in itertools.product([True, False], repeat=n)]
    rows = [(t, 2027 + y, held) for t, p in enumerate(patterns) for y, held in enumerate(p)]
    years = spark.createDataFrame(rows, "team long, year long, held boolean")
    got = {(r.team, r.year): r.tradeable for r in constraints.tradeable_years(years).collect()}
    gaps = {r.team: r.gap_from for r in constraints.consecutive_gaps(years.withColumn("bare", ~F.col("held"))).collect()}
    for t, p in enumerate(patterns):
        pair = next((2027 + i for i in range(len(p) - 1) if not p[i] and not p[i + 1]), None)
        assert gaps[t] == pair
        for y, held in enumerate(p):
            if held:
                q = [*p[:y], False, *p[y + 1 :]]
                assert got[(t, 2027 + y)] == all(q[i] or q[i + 1] for i in range(len(q) - 1))


def test_known_team_without_contracts_stands_at_zero(spark):
    """A team that is known but holds nothing has a position; a leg of any other team fails the job."""
    from factline.operators import position, trades

    season = [(1999, "1999-2000", 100, 120, 130, 140)]
    seasons = spark.createDataFrame(season, "season long, season_id string, salary_cap long, tax_level long, first_apron long, second_apron long")
    ledger = spark.createDataFrame([(1, 1999, "contract", 70, None, None)], "team long, season long, kind string, amount long, label string, offer long")
    ceilings = spark.createDataFrame([], "team long, season long, level string, category string, detail string")
    teams = spark.createDataFrame([(1,), (2,)], "team long")
    states = position.team_state(position.with_known_teams(ledger, teams, 1999, 1999), seasons, ceilings)
    assert {r.team: (r.apron_salary, r.standard_count, r.status) for r in states.collect()} == {1: (70, 1, "room"), 2: (0, 0, "room")}
    legs = "trade_id long, team long, season long, outgoing long, incoming long"
    found = trades.leg_states(spark.createDataFrame([(7, 1, 1999, 10, 5), (7, 2, 1999, 5, 10)], legs), states, 1)
    assert {r.team: r.post_salary for r in found.collect()} == {1: 65, 2: 5}
    with pytest.raises(Exception, match="no team 3"):
        trades.leg_states(spark.createDataFrame([(8, 3, 1999, 1, 1)], legs), states, 1).collect()


def test_a_mutant_that_is_still_legal_is_missed(spark):
    from factline.operators import corpus

    legs = spark.createDataFrame([(1, 1, 100, 90, 150), (1, 2, 90, 100, 150)], "trade_id long, team long, outgoing long, incoming long, capacity long")
    made = [(1, 1, 100, 150, "inflate_incoming", 999), (1, 1, 100, 150, "just_over_the_band", 150), (1, 2, 90, 150, "unbalance", 100), (1, 2, 90, 150, "unbalance", 107)]
    mutants = spark.createDataFrame(made, "trade_id long, team long, outgoing long, capacity long, kind string, mutated long")
    got = {(r.kind, r.mutated): (r.code, r.detected, r.right_reason) for r in corpus.detect(mutants, legs).collect()}
    assert got == {
        ("inflate_incoming", 999): ("no_exception_available", True, True),
        ("just_over_the_band", 150): (None, False, False),
        ("unbalance", 100): (None, False, False),
        ("unbalance", 107): ("unbalanced", True, True),
    }
