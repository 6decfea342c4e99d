"""Trade validation and the constraint reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from factline.functions import constants as K
from factline.operators import constraints as con
from factline.operators import trades
from factline.plans.registry import Registry
from factline.plans.views import BASE_CAP, RULES
from factline.sources import scratch

REG = Registry()
C = F.col


def sends(v):
    return trades.moves_to_legs(v.of("valid_moves")).where("direction = 'send'")


def settled(v):
    """Legs and sends read by several rules: the moves and the legs are written once."""
    v.keep("valid_moves", "legs")
    return v.of("legs"), sends(v)


@REG.add(
    "f01_moves_to_legs",
    "SELECT trade_id, team, direction, contract_id, player, amount FROM f_move_legs",
)
def f01(v):
    return trades.moves_to_legs(v.valid_moves).select(
        "trade_id", "team", "direction", "contract_id", "player", "amount"
    )


@REG.add("f02_trade_errors", "SELECT trade_id, n_moves, error FROM f_trade_errors")
def f02(v):
    return trades.trade_errors(v.moves)


@REG.add(
    "f03_incoming_with_kickers",
    """SELECT trade_id, team, incoming_base, incoming, n_unknown_kickers FROM f_legs""",
)
def f03(v):
    """Kickers raise what the receiving side takes back; unknown ones are assumptions."""
    return trades.leg_totals(v.valid_moves).select(
        "trade_id", "team", "incoming_base", "incoming", "n_unknown_kickers"
    )


@REG.add("f04_post_salary", "SELECT trade_id, team, apron_salary, outgoing, incoming, post_salary FROM f_legs")
def f04(v):
    return v.legs.select("trade_id", "team", "apron_salary", "outgoing", "incoming", "post_salary")


@REG.add("f05_check_matching", "SELECT trade_id, team, outgoing, incoming, used, code FROM f_matching")
def f05(v):
    legs, sent = settled(v)
    return trades.check_matching(legs, sent, RULES).select(
        "trade_id", "team", "outgoing", "incoming", "used", "code"
    )


@REG.add(
    "f06_check_ceiling",
    "SELECT trade_id, team, post_salary, ceiling_level, ceiling_amount, triggers FROM f_legs WHERE post_salary > ceiling_amount",
)
def f06(v):
    return trades.check_ceiling(v.legs).select(
        "trade_id", "team", "post_salary", "ceiling_level", "ceiling_amount", "triggers"
    )


@REG.add(
    "f07_check_aggregation",
    "SELECT trade_id, team, subject AS player FROM f_violations WHERE code = 'aggregation_two_month_bar'",
)
def f07(v):
    s = sends(v)
    legs = s.groupBy("trade_id", "team").agg(F.count("*").alias("n_sends"))
    return trades.check_aggregation(s, legs).select("trade_id", "team", "player")


@REG.add(
    "f08_check_restricted",
    "SELECT trade_id, team, subject AS player FROM f_violations WHERE code = 'player_trade_restricted'",
)
def f08(v):
    return trades.check_restricted(sends(v), v.restrictions).select("trade_id", "team", "player")


@REG.add(
    "f09_check_roster",
    """SELECT trade_id, team, standard_count - n_sends + n_receives AS after FROM f_legs
 WHERE standard_count - n_sends + n_receives > 15""",
)
def f09(v):
    return trades.check_roster(v.legs, RULES).select("trade_id", "team", "after")


@REG.add(
    "f10_validate_trades",
    """SELECT l.trade_id, coalesce(x.n, 0) = 0 AS legal, l.n_assumptions > 0 AS conditional, coalesce(x.n, 0) AS n_violations,
 l.n_assumptions, x.codes FROM (SELECT trade_id, CAST(sum(n_unknown_kickers) AS BIGINT) AS n_assumptions FROM f_legs GROUP BY 1) l
 LEFT JOIN (SELECT trade_id, count(*) AS n, string_agg(DISTINCT code, '|' ORDER BY code) AS codes FROM f_violations GROUP BY 1) x
 ON x.trade_id = l.trade_id""",
)
def f10(v):
    legs, sent = settled(v)
    return trades.verdicts(legs, trades.violations(legs, sent, v.restrictions, RULES))


CITES = "(VALUES " + ", ".join(
    f"('{code}', '{a}', '{s}', {p})" for code, (a, s, p, _) in K.CITATIONS.items()
) + ") c(code, article, section, page)"


@REG.add(
    "f11_with_citation",
    f"""SELECT x.trade_id, x.team, x.code, x.subject, c.article, c.section, CAST(c.page AS BIGINT) AS page
 FROM f_violations x LEFT JOIN {CITES} ON c.code = x.code""",
)
def f11(v):
    legs, sent = settled(v)
    found = trades.violations(legs, sent, v.restrictions, RULES)
    return trades.with_citation(found).drop("title")


@REG.add(
    "f12_triggered_notes",
    """SELECT trade_id, team, used, CASE used WHEN 'expanded' THEN 'E' WHEN 'transition' THEN 'G' ELSE 'H' END AS "row",
 CASE used WHEN 'aggregated' THEN 'second_apron' ELSE 'first_apron' END AS ceiling
 FROM f_matching WHERE used IN ('expanded', 'transition', 'aggregated')""",
)
def f12(v):
    legs, sent = settled(v)
    return trades.triggered_notes(trades.check_matching(legs, sent, RULES)).select(
        "trade_id", "team", "used", "row", "ceiling"
    )


@REG.add(
    "f13_trade_sides",
    """SELECT trade_id, team, cap_salary AS before_cap, apron_salary AS before_apron, status AS before_status,
 cap_salary + d AS after_cap, apron_salary + d AS after_apron,
 CASE WHEN cap_salary + d < salary_cap THEN 'room' WHEN apron_salary + d < tax_level THEN 'over_cap' WHEN apron_salary + d < first_apron THEN 'taxpayer'
 WHEN apron_salary + d < second_apron THEN 'first_apron' ELSE 'second_apron' END AS after_status,
 standard_count - n_sends + n_receives AS after_contracts FROM (SELECT *, incoming_base - outgoing AS d FROM f_legs)""",
)
def f13(v):
    return trades.trade_sides(v.legs)


HARD_CAP = """SELECT team, season, NULL::BIGINT AS player, 'hard_cap' AS kind, ceiling_amount - apron_salary AS value, ceiling_amount - apron_salary <= 0 AS blocking
 FROM f_positions WHERE ceiling_amount IS NOT NULL
 UNION ALL SELECT team, season, NULL, 'no_hard_cap', NULL, false FROM f_positions WHERE ceiling_amount IS NULL
 UNION ALL SELECT p.team, p.season, NULL, 'hard_cap_superseded', NULL, false FROM f_positions p JOIN f_ceilings c ON c.team = p.team AND c.season = p.season AND c.level <> p.ceiling_level"""
RESTRICTED = """SELECT a.team, a.season, a.player, CASE WHEN r.blocks_trade THEN 'may_not_be_traded' ELSE 'may_not_be_aggregated' END AS kind,
 NULL::BIGINT AS value, r.blocks_trade AS blocking FROM f_asked a JOIN f_restrictions r ON r.player = a.player
 AND (r.expires IS NULL OR make_date(a.season, 12, 1) <= r.expires)"""
PLAYER = """SELECT a.team, a.season, a.player, CASE WHEN h.contract_id IS NULL THEN 'unknown_player' WHEN h.kicker_state = 'unknown' THEN 'unknown_trade_kicker'
 ELSE 'trade_kicker' END AS kind, NULL::BIGINT AS value, h.contract_id IS NULL AS blocking
 FROM f_asked a LEFT JOIN f_held h ON h.team = a.team AND h.season = a.season AND h.player = a.player WHERE coalesce(h.kicker_state, '') <> 'absent'"""
APRON = """SELECT * FROM (SELECT p.team, p.season, NULL::BIGINT AS player, 'apron_row_' || r.row AS kind,
 CASE r.level WHEN 'first_apron' THEN p.first_apron ELSE p.second_apron END AS value, false AS blocking FROM f_positions p, {rows}
 WHERE r.row <> 'G' AND NOT ((p.season_id = '1998-1999' AND r.row BETWEEN 'F' AND 'J') OR p.apron_salary <= CASE r.level WHEN 'first_apron' THEN p.first_apron ELSE p.second_apron END)
 UNION ALL SELECT team, season, NULL, 'no_apron_restriction', NULL, false FROM f_positions WHERE apron_salary <= first_apron)""".format(
    rows="(VALUES " + ", ".join(f"('{r}', '{lv}')" for r, lv, _ in K.RESTRICTION_ROWS) + ") r(row, level)"
)
ROSTER = """SELECT team, season, NULL::BIGINT AS player, CASE WHEN standard_count <= 14 THEN 'roster_minimum' ELSE 'roster_spare' END AS kind,
 CASE WHEN standard_count <= 14 THEN standard_count ELSE standard_count - 14 END AS value, false AS blocking FROM f_positions
 UNION ALL SELECT team, season, NULL, 'roster_maximum', standard_count, false FROM f_positions WHERE standard_count >= 15"""
WINDOW = """SELECT a.team, a.season, a.player, CASE WHEN h.signed_date IS NULL THEN 'signing_date_unknown'
 WHEN h.contract_type LIKE 'rookie%' AND make_date(a.season, 12, 1) < h.signed_date + 30 THEN 'trade_window' ELSE 'flags_not_carried' END AS kind, NULL::BIGINT AS value,
 coalesce(h.contract_type LIKE 'rookie%' AND make_date(a.season, 12, 1) < h.signed_date + 30, false) AS blocking
 FROM f_asked a LEFT JOIN f_held h ON h.team = a.team AND h.season = a.season AND h.player = a.player"""
NTC = """SELECT a.team, a.season, a.player, CASE h.ntc_state WHEN 'known' THEN 'no_trade_clause' ELSE 'unknown_no_trade_clause' END AS kind, NULL::BIGINT AS value,
 h.ntc_state = 'known' AS blocking FROM f_asked a JOIN f_held h ON h.team = a.team AND h.season = a.season AND h.player = a.player WHERE h.ntc_state <> 'absent'"""
CAPACITY = """SELECT team, season, player, 'take_back_capacity' AS kind, greatest(x + c, least(x * 2 + c, x + CAST(trunc(cap::DOUBLE * 7500000 / 440000000) AS BIGINT)),
 CAST(trunc(x * 1.25::DOUBLE) AS BIGINT) + c) AS value, false AS blocking FROM (
 SELECT a.team, a.season, a.player, h.cap_figure AS x, CASE WHEN p.apron_salary > p.first_apron THEN 0 ELSE 250000 END AS c, p.salary_cap AS cap
 FROM f_asked a JOIN f_held h ON h.team = a.team AND h.season = a.season AND h.player = a.player JOIN f_positions p ON p.team = a.team AND p.season = a.season)"""


def december(season="season"):
    return F.make_date(C(season).cast("int"), F.lit(12), F.lit(1))


@REG.add("f14_constraints_hard_cap", HARD_CAP)
def f14(v):
    return con.hard_cap(v.positions, v.ceilings)


@REG.add("f15_constraints_restrictions", RESTRICTED)
def f15(v):
    return con.restrictions(v.asked, v.restrictions, december())


@REG.add("f16_constraints_player", PLAYER)
def f16(v):
    return con.player_terms(v.asked, v.held)


@REG.add("f17_constraints_apron", APRON)
def f17(v):
    return con.apron_rows(v.positions, RULES)


@REG.add(
    "f18_consecutive_gaps",
    """WITH b AS (SELECT team, year, NOT held OR lost AS bare FROM f_pick_years)
 SELECT b.team, count(*) FILTER (bare) AS n_bare, min(b.year) FILTER (bare AND EXISTS (SELECT 1 FROM b n WHERE n.team = b.team AND n.year = b.year + 1 AND n.bare)) AS gap_from,
 min(b.year) FILTER (bare AND EXISTS (SELECT 1 FROM b n WHERE n.team = b.team AND n.year = b.year + 1 AND n.bare)) + 1 AS gap_to,
 count(*) FILTER (bare AND EXISTS (SELECT 1 FROM b n WHERE n.team = b.team AND n.year = b.year + 1 AND n.bare)) = 0 AS permitted
 FROM b GROUP BY b.team""",
)
def f18(v):
    years = con.pick_years(v.first_picks).withColumn("bare", ~C("held") | C("lost"))
    return con.consecutive_gaps(years)


@REG.add(
    "f19_tradeable_years",
    """WITH y AS (SELECT team, year, held FROM f_pick_years)
 SELECT y.team, y.year, NOT EXISTS (SELECT 1 FROM y a JOIN y b ON b.team = a.team AND b.year = a.year + 1
   WHERE a.team = y.team AND (NOT a.held OR a.year = y.year) AND (NOT b.held OR b.year = y.year)) AS tradeable
 FROM y WHERE y.held""",
)
def f19(v):
    return con.tradeable_years(con.pick_years(v.first_picks))


@REG.add(
    "f20_pick_conveys",
    """SELECT original_team, year, owner, slot FROM (SELECT *, unnest(range(1::BIGINT, 31)) AS slot FROM f_picks WHERE round = 1 AND NOT forfeited) WHERE slot > protected_to""",
)
def f20(v):
    slots = v.first_picks.select(
        "original_team", "year", F.explode(F.sequence(F.lit(1), F.lit(30))).alias("slot")
    )
    protections = v.first_picks.where("protected_to > 0").select(
        "original_team", "year", F.lit(1).alias("low"), C("protected_to").alias("high")
    )
    return con.pick_conveys(v.first_picks, slots, protections)


@REG.add("f21_constraints_roster", ROSTER)
def f21(v):
    return con.roster(v.positions, RULES)


@REG.add("f22_constraints_window", WINDOW)
def f22(v):
    return con.trade_window(v.asked, v.held, december())


@REG.add("f23_constraints_ntc", NTC)
def f23(v):
    return con.no_trade_clause(v.asked, v.held)


@REG.add("f24_constraints_capacity", CAPACITY)
def f24(v):
    return con.capacity(v.asked, v.held, v.positions, BASE_CAP)


@REG.add(
    "f25_team_constraints",
    """SELECT team, season, count(*) AS n_constraints, count(*) FILTER (blocking) AS n_blocking,
 count(*) FILTER (kind IN ('unknown_trade_kicker', 'unknown_no_trade_clause', 'signing_date_unknown', 'flags_not_carried')) AS n_assumptions FROM (
 """
    + " UNION ALL ".join([HARD_CAP, RESTRICTED, PLAYER, APRON, ROSTER, WINDOW, NTC, CAPACITY])
    + ") GROUP BY team, season",
)
def f25(v):
    v.keep("positions")
    positions = v.of("positions")
    # Questions meet contracts once; the reports read that, where only whether there is a contract counts, not its id.
    asked = scratch.written(con.under_contract(v.asked, v.held).drop("contract_id"), "asked")
    return con.summary(
        con.report(
            [
                con.hard_cap(positions, v.ceilings),
                con.restrictions(asked, v.restrictions, december()),
                con.player_terms(asked),
                con.apron_rows(positions, RULES),
                con.roster(positions, RULES),
                con.trade_window(asked, None, december()),
                con.no_trade_clause(asked),
                con.capacity(asked, None, positions, BASE_CAP),
            ]
        )
    )
