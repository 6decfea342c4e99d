"""Team positions and the cap sheet."""

from __future__ import annotations

from pyspark.sql import functions as F

from factline.functions import rules as R
from factline.operators import position as pos
from factline.plans.registry import Registry

REG = Registry()
C = F.col
SEASON = 1999


@REG.add(
    "d01_maybe",
    """SELECT contract_id, kicker_state AS state, CASE WHEN kicker_state = 'known' THEN pct END AS value FROM f_contract_seasons""",
)
def d01(v):
    return v.contract_seasons.withColumn("m", pos.maybe(C("kicker_state"), C("pct"))).select(
        "contract_id", "m.state", "m.value"
    )


@REG.add(
    "d02_assume",
    """SELECT contract_id, CASE WHEN kicker_state = 'known' THEN pct ELSE 0 END AS value,
 CASE WHEN kicker_state = 'unknown' THEN 'trade_kicker_pct' END AS assumed_field, CASE WHEN kicker_state = 'unknown' THEN CAST(player AS VARCHAR) END AS subject
 FROM f_contract_seasons""",
)
def d02(v):
    m = pos.maybe(C("kicker_state"), C("pct"))
    a = pos.assume(m, F.lit(0.0), "trade_kicker_pct", C("player"), "not published by any available source")
    return v.contract_seasons.withColumn("a", a).select(
        "contract_id",
        "a.value",
        F.get(C("a.assumptions"), F.lit(0))["field"].alias("assumed_field"),
        F.get(C("a.assumptions"), F.lit(0))["subject"].alias("subject"),
    )


@REG.add(
    "d03_assemble_contracts",
    """SELECT contract_id, count(*) AS n_years, string_agg(season || ':' || cap_figure || ':' || guarantee_kind || ':' || coalesce(option_kind, ''), '|' ORDER BY season) AS years
 FROM f_years GROUP BY contract_id""",
)
def d03(v):
    text = F.transform(
        "years",
        lambda y: F.concat_ws(
            ":", y["season"], y["cap_figure"], y["guarantee_kind"], F.coalesce(y["option_kind"], F.lit(""))
        ),
    )
    return pos.assemble_contracts(v.years).select(
        "contract_id", F.size("years").alias("n_years"), F.array_join(text, "|").alias("years")
    )


@REG.add(
    "d04_hold_kind",
    """SELECT contract_id, label, CASE WHEN label LIKE 'Restricted%' THEN 'qualifying_offer' WHEN label IN ('1st Round Pick', 'Draft Pick') THEN 'draft_pick'
 WHEN label = 'Two-Way' THEN 'two_way' ELSE 'free_agent' END AS kind,
 CASE label WHEN 'Bird' THEN 'Bird' WHEN 'Restricted Bird' THEN 'Bird' WHEN 'Early Bird' THEN 'Early Bird' WHEN 'Non-Bird' THEN 'Non-Bird'
 WHEN 'Restricted Non-Bird' THEN 'Non-Bird' ELSE 'None' END AS rights FROM f_holds""",
)
def d04(v):
    return v.holds.select(
        "contract_id", "label", R.hold_kind(C("label")).alias("kind"), R.bird_rights(C("label")).alias("rights")
    )


@REG.add(
    "d05_holds_for_season",
    f"SELECT contract_id, team, amount, season, nullif(offer, 0) AS offer FROM f_holds WHERE season = {SEASON} OR season IS NULL",
)
def d05(v):
    return pos.holds_for(v.holds, SEASON).select("contract_id", "team", "amount", "season", "offer")


@REG.add(
    "d06_committed_salary",
    "SELECT team, season, CAST(sum(cap_figure) AS BIGINT) AS committed FROM f_contract_seasons GROUP BY ALL",
)
def d06(v):
    return v.contract_seasons.groupBy("team", "season").agg(F.sum("cap_figure").alias("committed"))


@REG.add("d07_cap_salary", "SELECT team, season, committed, dead, holds, committed + dead + holds AS cap_salary FROM f_totals")
def d07(v):
    return pos.team_totals(v.ledger).select("team", "season", "committed", "dead", "holds", "cap_salary")


@REG.add("d08_apron_salary", "SELECT team, season, restricted, committed + dead + restricted AS apron_salary FROM f_totals")
def d08(v):
    return pos.team_totals(v.ledger).select("team", "season", "restricted", "apron_salary")


@REG.add("d09_apron_status", "SELECT team, season, cap_salary, apron_salary, status FROM f_positions")
def d09(v):
    return (
        pos.with_thresholds(pos.team_totals(v.ledger), v.seasons)
        .withColumn("status", pos.status_column())
        .select("team", "season", "cap_salary", "apron_salary", "status")
    )


@REG.add(
    "d10_binding_ceiling",
    """SELECT team, season, ceiling_level, ceiling_amount, ceiling_amount - apron_salary AS room_below, triggers
 FROM f_positions WHERE ceiling_level IS NOT NULL""",
)
def d10(v):
    return v.positions.where("ceiling_level is not null").select(
        "team", "season", "ceiling_level", "ceiling_amount",
        (C("ceiling_amount") - C("apron_salary")).alias("room_below"), "triggers",
    )


@REG.add(
    "d11_trigger_text",
    "SELECT team, season, level, category || CASE WHEN detail IS NULL THEN '' ELSE ' — ' || detail END AS trigger_text FROM f_ceilings",
)
def d11(v):
    return v.ceilings.select(
        "team", "season", "level", pos.trigger_text(C("category"), C("detail")).alias("trigger_text")
    )


@REG.add(
    "d12_season_thresholds",
    """SELECT s.season_id, salary_cap, tax_level, first_apron, second_apron, count(*) AS n_orders FROM f_seasons s
 JOIN orders ON year(o_orderdate) - CASE WHEN month(o_orderdate) < 7 THEN 1 ELSE 0 END = s.season GROUP BY ALL""",
)
def d12(v):
    used = v.orders.groupBy(R.season_start(C("o_orderdate").cast("date")).alias("season")).agg(
        F.count("*").alias("n_orders")
    )
    return used.join(F.broadcast(pos.strict_thresholds(v.seasons)), "season").select(
        "season_id", "salary_cap", "tax_level", "first_apron", "second_apron", "n_orders"
    )


@REG.add(
    "d13_eval_seasons",
    """SELECT s.season_id, CASE WHEN raw_second = 0 THEN first_apron ELSE raw_second END AS second_apron, count(*) AS n_orders FROM f_seasons s
 JOIN orders ON year(o_orderdate) - CASE WHEN month(o_orderdate) < 7 THEN 1 ELSE 0 END = s.season GROUP BY ALL""",
)
def d13(v):
    used = v.orders.groupBy(R.season_start(C("o_orderdate").cast("date")).alias("season")).agg(
        F.count("*").alias("n_orders")
    )
    seasons = v.seasons.withColumn(
        "second_apron", pos.second_or_first(C("raw_second"), C("first_apron"))
    )
    return used.join(F.broadcast(seasons), "season").select("season_id", "second_apron", "n_orders")


@REG.add("d14_team_state", "SELECT * FROM f_positions")
def d14(v):
    return v.positions


@REG.add(
    "d15_cap_sheet_lines",
    """SELECT 'contract' AS kind, contract_id, team, season, cap_figure AS amount, cap_figure AS cap, cap_figure AS apron, NULL AS label, 0::BIGINT AS kind_rank FROM f_contract_seasons
 UNION ALL SELECT 'dead', contract_id, team, season, amount, amount, amount, NULL, 1 FROM f_dead
 UNION ALL SELECT 'hold', contract_id, team, season, amount, amount, CASE WHEN label LIKE 'Restricted%' THEN CASE WHEN offer > 0 THEN offer ELSE amount END ELSE 0 END, label, 2 FROM f_holds""",
)
def d15(v):
    return pos.cap_sheet_lines(v.ledger).select(
        "kind", "contract_id", "team", "season", "amount", "cap", "apron", "label", "kind_rank"
    )


LATER = """SELECT *, dense_rank() OVER (PARTITION BY team, season ORDER BY later) AS "column" FROM (
 SELECT team, first_season AS season, season AS later, CAST(sum(cap_figure) AS BIGINT) AS total
 FROM f_years WHERE season > first_season GROUP BY ALL)"""


@REG.add("d16_later_totals", f"SELECT * FROM ({LATER}) WHERE \"column\" <= 4")
def d16(v):
    return pos.later_totals(v.years)


@REG.add(
    "d17_exception_expired",
    "SELECT contract_id, CAST(expires AS VARCHAR) AS expires, expires < DATE '2000-03-01' AS expired FROM f_exceptions",
)
def d17(v):
    return v.exceptions.select(
        "contract_id", "expires",
        R.exception_expired(C("expires"), F.lit("2000-03-01").cast("date")).alias("expired"),
    )


@REG.add(
    "d18_cap_sheet",
    f"""SELECT p.team, p.season, p.status, p.cap_salary, p.apron_salary, p.ceiling_amount - p.apron_salary AS ceiling_room,
 (SELECT count(*) FROM f_contract_seasons c WHERE c.team = p.team AND c.season = p.season) AS n_contract,
 (SELECT count(*) FROM f_dead d WHERE d.team = p.team AND d.season = p.season) AS n_dead,
 (SELECT count(*) FROM f_holds h WHERE h.team = p.team AND h.season = p.season) AS n_hold,
 coalesce(e.n, 0) AS n_exceptions, l.total AS later_total,
 'unknown_terms' || CASE WHEN coalesce(e.n, 0) > 0 THEN '|older_exceptions' ELSE '' END AS warnings
 FROM f_positions p LEFT JOIN (SELECT team, count(*) AS n FROM f_exceptions GROUP BY 1) e ON e.team = p.team
 LEFT JOIN (SELECT team, season, CAST(sum(total) AS BIGINT) AS total FROM ({LATER}) WHERE "column" <= 4 GROUP BY ALL) l ON l.team = p.team AND l.season = p.season""",
)
def d18(v):
    # Everything here is summed by team: figures move once a branch, and sums and joins stay where they are.
    contracts = v.contracts("team")
    return pos.cap_sheet(
        v.positions, pos.cap_sheet_lines(v.ledger_of(contracts)), v.exceptions, pos.later_totals(v.years_of(contracts))
    ).select(
        "team", "season", "status", "cap_salary", "apron_salary", "ceiling_room", "n_contract",
        "n_dead", "n_hold", "n_exceptions", "later_total", "warnings",
    )


@REG.add(
    "d19_cap_position",
    """SELECT team, season, status, salary_cap - cap_salary AS room, tax_level - apron_salary AS to_tax,
 first_apron - apron_salary AS to_first, second_apron - apron_salary AS to_second FROM f_positions
 ORDER BY room DESC, team, season""",
)
def d19(v):
    return pos.headroom(v.positions).orderBy(F.desc("room"), "team", "season")


@REG.add(
    "d20_current_teams",
    f"""SELECT p.player_key, c.team FROM f_players p LEFT JOIN (SELECT player, arg_min(team, contract_id) AS team
 FROM f_contract_seasons WHERE season = {SEASON} AND cap_figure > 0 GROUP BY 1) c ON c.player = p.player""",
)
def d20(v):
    return pos.current_teams(v.players.select("player", "player_key"), v.contract_seasons, SEASON).select(
        "player_key", "team"
    )


@REG.add(
    "d21_with_names",
    "SELECT contract_id, display_name FROM f_lines l LEFT JOIN f_players p ON p.player = l.player",
)
def d21(v):
    return pos.with_names(v.lines.select("contract_id", "player"), v.players).select(
        "contract_id", "display_name"
    )


MARKS = """SELECT team, season, 'salary_cap' AS mark, salary_cap AS amount, 'cap' AS against, cap_salary - salary_cap AS over FROM f_positions
 UNION ALL SELECT team, season, 'tax_level', tax_level, 'apron', apron_salary - tax_level FROM f_positions
 UNION ALL SELECT team, season, 'first_apron', first_apron, 'apron', apron_salary - first_apron FROM f_positions
 UNION ALL SELECT team, season, 'second_apron', second_apron, 'apron', apron_salary - second_apron FROM f_positions
 UNION ALL SELECT team, season, 'ceiling', ceiling_amount, 'apron', apron_salary - ceiling_amount FROM f_positions WHERE ceiling_amount IS NOT NULL"""


@REG.add("d22_threshold_marks", MARKS)
def d22(v):
    return v.positions.select("team", "season", F.inline(pos.threshold_marks()))


MILLIONS = "'$' || printf('%.1f', (abs({x}) + CASE WHEN abs({x}) % 1000000 = 250000 THEN 1 ELSE 0 END) / 1000000.0::DOUBLE) || 'M'"


@REG.add(
    "d23_money_text",
    f"""SELECT team, season, mark, '$' || format('{{:,}}', amount) AS dollars, CASE WHEN over < 0 THEN '−' ELSE '' END || '$' || format('{{:,}}', abs(over)) AS over_dollars,
 {MILLIONS.format(x='amount')} AS millions,
 CASE WHEN over = 0 THEN 'exactly at' ELSE {MILLIONS.format(x='over')} || CASE WHEN over < 0 THEN ' under' ELSE ' over' END END AS text FROM ({MARKS})""",
)
def d23(v):
    return v.positions.select("team", "season", F.inline(pos.threshold_marks())).select(
        "team", "season", "mark",
        R.fmt_dollars(C("amount")).alias("dollars"),
        R.fmt_dollars(C("over")).alias("over_dollars"),
        R.fmt_millions(C("amount")).alias("millions"),
        R.describe_over(C("over")).alias("text"),
    )
