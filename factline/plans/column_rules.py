"""Per-row rules run over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from factline.functions import constants as K
from factline.functions import rules as R
from factline.operators import structures
from factline.plans.registry import Registry
from factline.plans.views import BASE_CAP, RULES
from factline.sources import scratch

REG = Registry()
C = F.col

LEG = "SELECT trade_id, team, outgoing, incoming, "
TRANSITION = "CASE WHEN season_id = '1998-1999' THEN CAST(trunc(outgoing * 1.10) AS BIGINT) + cushion END"
EXPANDED = (
    "greatest(least(CAST(trunc(outgoing * 2.0::DOUBLE) AS BIGINT) + cushion, "
    "outgoing + CAST(trunc(salary_cap::DOUBLE * 7500000 / base_cap) AS BIGINT)), "
    "CAST(trunc(outgoing * 1.25::DOUBLE) AS BIGINT) + cushion)"
)
TRANSITION = TRANSITION.replace("1.10", "1.10::DOUBLE")


@REG.add("e01_cushion", LEG + "post_salary, CAST(cushion AS BIGINT) AS cushion FROM f_legs")
def e01(v):
    return v.legs.select("trade_id", "team", "outgoing", "incoming", "post_salary", "cushion")


@REG.add("e02_allow_standard", LEG + "CAST(outgoing + cushion AS BIGINT) AS allowance FROM f_legs")
def e02(v):
    return v.legs.select(
        "trade_id", "team", "outgoing", "incoming",
        R.allow_standard(C("outgoing"), C("cushion")).alias("allowance"),
    )


@REG.add("e03_allow_transition", LEG + f"{TRANSITION} AS allowance FROM f_legs")
def e03(v):
    return v.legs.select(
        "trade_id", "team", "outgoing", "incoming",
        R.allow_transition(C("outgoing"), C("cushion"), C("season_id"), RULES).alias("allowance"),
    )


@REG.add("e04_allow_expanded", LEG + f"{EXPANDED} AS allowance FROM f_legs")
def e04(v):
    return v.legs.select(
        "trade_id", "team", "outgoing", "incoming",
        R.allow_expanded(C("outgoing"), C("cushion"), C("salary_cap"), C("base_cap")).alias("allowance"),
    )


@REG.add("e05_allow_room", LEG + "CAST(cap_room + cushion AS BIGINT) AS allowance FROM f_legs")
def e05(v):
    return v.legs.select(
        "trade_id", "team", "outgoing", "incoming",
        R.allow_room(C("cap_room"), C("cushion")).alias("allowance"),
    )


@REG.add(
    "e06_best_allowance",
    LEG
    + f"""
 CASE WHEN cap_room > 0 AND incoming <= cap_room + cushion THEN 'room'
      WHEN n_sends < 2 AND incoming <= outgoing + cushion THEN 'standard'
      WHEN n_sends >= 2 AND incoming <= outgoing + cushion THEN 'aggregated'
      WHEN incoming <= {TRANSITION} THEN 'transition'
      WHEN incoming <= {EXPANDED} THEN 'expanded' END AS kind,
 CAST(CASE WHEN cap_room > 0 AND incoming <= cap_room + cushion THEN cap_room + cushion
      WHEN incoming <= outgoing + cushion THEN outgoing + cushion
      WHEN incoming <= {TRANSITION} THEN {TRANSITION}
      WHEN incoming <= {EXPANDED} THEN {EXPANDED} END AS BIGINT) AS amount
 FROM f_legs""",
)
def e06(v):
    best = R.best_allowance(
        C("outgoing"), C("incoming"), C("cushion"), C("season_id"), C("salary_cap"),
        C("base_cap"), C("n_sends") >= 2, C("cap_room"), rules=RULES,
    )
    return v.legs.withColumn("b", best).select(
        "trade_id", "team", "outgoing", "incoming", "b.kind", "b.amount"
    )


ORDER_LEGS = """
WITH RECURSIVE parts(n, masks) AS (
  SELECT 0, []::BIGINT[]
  UNION ALL
  SELECT n + 1, CASE WHEN k <= len(masks)
    THEN list_transform(masks, lambda m, i: CASE WHEN i = k THEN m + CAST(pow(2, n) AS BIGINT) ELSE m END)
    ELSE list_append(masks, CAST(pow(2, n) AS BIGINT)) END
  FROM parts, range(1, 10) t(k) WHERE n < 8 AND k <= len(masks) + 1),
legs AS (
  SELECT c.order_id, any_value(s.salary_cap) AS cap, list(c.cap_figure ORDER BY c.contract_id) AS vals,
         count(*) AS n, sum(c.cap_figure)::BIGINT AS whole,
         sum(greatest(c.cap_figure + 250000, least(c.cap_figure * 2 + 250000, c.cap_figure + CAST(trunc(s.salary_cap::DOUBLE * 7500000 / 440000000) AS BIGINT)),
             CAST(trunc(c.cap_figure * 1.25::DOUBLE) AS BIGINT) + 250000))::BIGINT AS singles
  FROM f_contract_seasons c JOIN f_seasons s ON s.season = c.season GROUP BY c.order_id),
small AS (
  SELECT order_id, cap, masks, list_transform(masks, lambda m: list_sum(list_transform(vals, lambda x, i: CASE WHEN (m >> (i - 1)) & 1 = 1 THEN x ELSE 0 END))::BIGINT) AS sums
  FROM legs JOIN parts USING (n) WHERE n <= 8),
best AS (
  SELECT order_id, max(list_sum(list_transform(sums, lambda x: greatest(x + 250000,
     least(x * 2 + 250000, x + CAST(trunc(cap::DOUBLE * 7500000 / 440000000) AS BIGINT)),
     CAST(trunc(x * 1.25::DOUBLE) AS BIGINT) + 250000)))::BIGINT) AS total FROM small GROUP BY order_id)
SELECT order_id, n, CASE WHEN n <= 8 THEN total ELSE greatest(singles, whole + 250000,
   least(whole * 2 + 250000, whole + CAST(trunc(cap::DOUBLE * 7500000 / 440000000) AS BIGINT)),
   CAST(trunc(whole * 1.25::DOUBLE) AS BIGINT) + 250000) END AS total
FROM legs LEFT JOIN best USING (order_id)
"""


@REG.add("e07_best_structure", ORDER_LEGS)
def e07(v):
    c = scratch.written(
        v.contract_seasons.select("order_id", "season", "cap_figure", "contract_id"), "order-legs"
    )
    legs = (
        c.groupBy("order_id").agg(F.min("season").alias("season"), F.count("*").alias("n_lines"))
        .join(F.broadcast(v.seasons.select("season", "salary_cap")), "season")
        .withColumn("base_cap", R.big(BASE_CAP))
        .withColumn("cushion", R.big(K.ALLOWANCE))
    )
    sends = c.select("order_id", C("cap_figure").alias("amount"), "contract_id")
    out = structures.best_structures(sends, legs, ["order_id"], ["contract_id"])
    return out.select("order_id", C("n_lines").alias("n"), C("structure_total").alias("total"))


@REG.add(
    "e08_leg_capacity",
    LEG
    + """CAST(greatest(outgoing + 250000,
     least(outgoing * 2 + 250000, outgoing + CAST(trunc(salary_cap::DOUBLE * 7500000 / base_cap) AS BIGINT)),
     CAST(trunc(outgoing * 1.25::DOUBLE) AS BIGINT) + 250000) AS BIGINT) AS capacity,
     outgoing > 0 AND incoming <= greatest(outgoing + 250000,
     least(outgoing * 2 + 250000, outgoing + CAST(trunc(salary_cap::DOUBLE * 7500000 / base_cap) AS BIGINT)),
     CAST(trunc(outgoing * 1.25::DOUBLE) AS BIGINT) + 250000) AS permits FROM f_legs""",
)
def e08(v):
    from factline.operators import corpus

    return v.legs.withColumn(
        "capacity", corpus.single_capacity(C("outgoing"), C("salary_cap"), C("base_cap"))
    ).select(
        "trade_id", "team", "outgoing", "incoming", "capacity",
        corpus.permits(C("outgoing"), C("incoming"), C("capacity")).alias("permits"),
    )


ROWS_SQL = "(VALUES " + ", ".join(f"('{r}', '{lv}')" for r, lv, _ in K.RESTRICTION_ROWS) + ") r(row, level)"
PERMITTED = (
    "(season_id = '1998-1999' AND row BETWEEN 'F' AND 'J') OR apron_salary <= "
    "CASE level WHEN 'first_apron' THEN first_apron ELSE second_apron END"
)


def _rows(df, salary=None, **kw):
    salary = C("apron_salary") if salary is None else salary
    return F.inline(
        R.restriction_rows(salary, C("first_apron"), C("second_apron"), C("season_id"), RULES, **kw)
    )


@REG.add(
    "e09_may_engage",
    f"SELECT team, season, row, level, CASE level WHEN 'first_apron' THEN first_apron ELSE second_apron END "
    f"AS level_amount, {PERMITTED} AS permitted FROM f_positions, {ROWS_SQL}",
)
def e09(v):
    p = v.positions
    return p.select("team", "season", _rows(p)).drop("phrase")


@REG.add(
    "e10_barred_transactions",
    f"SELECT team, season, salary_added, row, level FROM (SELECT *, unnest([0::BIGINT, 5000000]) AS salary_added FROM f_positions) p, {ROWS_SQL} "
    f"WHERE row <> 'G' AND NOT ({PERMITTED.replace('apron_salary', 'apron_salary + salary_added')})",
)
def e10(v):
    p = v.positions.withColumn(
        "salary_added", F.explode(F.array(R.big(0), R.big(5_000_000)))
    )
    rows = _rows(p, C("apron_salary") + C("salary_added"), reachable_only=True)
    return p.select("team", "season", "salary_added", rows).where("not permitted").drop(
        "permitted", "phrase", "level_amount"
    )


@REG.add(
    "e11_explain_position",
    f"""SELECT team, season,
 coalesce(string_agg(row, ', ' ORDER BY row) FILTER (level = 'first_apron' AND NOT ({PERMITTED})), '') AS first_rows,
 coalesce(string_agg(row, ', ' ORDER BY row) FILTER (level = 'second_apron' AND NOT ({PERMITTED})), '') AS second_rows
 FROM f_positions, {ROWS_SQL} WHERE row <> 'G' GROUP BY team, season""",
)
def e11(v):
    rows = R.restriction_rows(
        C("apron_salary"), C("first_apron"), C("second_apron"), C("season_id"), RULES, True
    )

    def closed(level):
        return F.array_join(
            F.transform(
                F.filter("rows", lambda r: (r["level"] == level) & ~r["permitted"]), lambda r: r["row"]
            ),
            ", ",
        )

    return v.positions.withColumn("rows", rows).select(
        "team", "season",
        closed("first_apron").alias("first_rows"),
        closed("second_apron").alias("second_rows"),
    )


@REG.add(
    "e12_requires_near_cap",
    """SELECT p.team, p.season, cap_salary, s.non_taxpayer_mle AS exception_amount,
 p.cap_salary >= p.salary_cap OR p.salary_cap - p.cap_salary < s.non_taxpayer_mle AS usable
 FROM f_positions p JOIN f_seasons s ON p.season = s.season""",
)
def e12(v):
    mle = F.broadcast(v.seasons.select("season", C("non_taxpayer_mle").alias("exception_amount")))
    return v.positions.join(mle, "season").select(
        "team", "season", "cap_salary", "exception_amount",
        R.requires_near_cap(C("cap_salary"), C("exception_amount"), C("salary_cap")).alias("usable"),
    )


E13_PCT = """CASE WHEN yos < 7 AND crit AND fifth THEN 0.30 WHEN yos IN (8, 9) AND crit AND vet THEN 0.35
 WHEN yos < 7 THEN 0.25 WHEN yos < 10 THEN 0.30 ELSE 0.35 END"""


@REG.add(
    "e13_max_salary",
    f"""WITH x AS (SELECT c.contract_id, p.years_of_service AS yos, s.salary_cap AS cap, c.cap_figure AS prior,
   p.kind IN ('PROMO', 'LARGE') AS crit, p.years_of_service = 4 AS fifth, c.flag = 'A' AS vet
   FROM f_contract_seasons c JOIN f_players p ON p.player = c.player JOIN f_seasons s ON s.season = c.season),
 y AS (SELECT *, CAST({E13_PCT} AS DOUBLE) AS percentage FROM x),
 z AS (SELECT *, CAST(trunc(percentage * cap::DOUBLE) AS BIGINT) AS by_pct, CAST(trunc(prior * 10 * 1.05::DOUBLE) AS BIGINT) AS floor FROM y)
 SELECT contract_id, greatest(by_pct, floor) AS amount, percentage,
 CASE WHEN yos < 7 THEN 'under_seven' WHEN yos < 10 THEN 'seven_to_nine' ELSE 'ten_plus' END AS tier,
 floor > by_pct AS used_prior_floor, (yos < 7 AND crit AND fifth) OR (yos IN (8, 9) AND crit AND vet) AS higher_max FROM z""",
)
def e13(v):
    c = v.contract_seasons.select("contract_id", "player", "season", "cap_figure", "flag")
    p = v.players.select("player", "years_of_service", "kind")
    m = R.max_salary(
        C("years_of_service"), C("salary_cap"), C("cap_figure") * 10,
        C("kind").isin("PROMO", "LARGE"), C("years_of_service") == 4, C("flag") == "A",
    )
    return (
        c.join(p, "player")
        .join(F.broadcast(v.seasons.select("season", "salary_cap")), "season")
        .withColumn("m", m)
        .select("contract_id", "m.*")
    )


@REG.add(
    "e14_deemed_salary",
    """SELECT contract_id, count(*) AS n_years, CASE WHEN any_value(flag) = 'A'
 THEN CAST(sum(cap_figure) // count(*) AS BIGINT) ELSE min(cap_figure) END AS deemed
 FROM f_years GROUP BY contract_id""",
)
def e14(v):
    return (
        v.years.groupBy("contract_id")
        .agg(
            F.count("*").alias("n_years"),
            F.sum("cap_figure").cast("bigint").alias("total"),
            F.min("cap_figure").alias("final_year"),
            F.min("flag").alias("flag"),
        )
        .select(
            "contract_id", "n_years",
            R.deemed_salary(C("final_year"), C("total"), C("n_years"), C("flag") == "A").alias("deemed"),
        )
    )


@REG.add(
    "e15_arenas",
    """SELECT contract_id, p.years_of_service IN (1, 2) AS applies, s.non_taxpayer_mle AS first_year_limit,
 cap_figure - CAST(trunc(0.045::DOUBLE * cap_figure) AS BIGINT) AS fourth_low,
 cap_figure + CAST(trunc(0.045::DOUBLE * cap_figure) AS BIGINT) AS fourth_high
 FROM f_contract_seasons c JOIN f_players p ON p.player = c.player JOIN f_seasons s ON s.season = c.season""",
)
def e15(v):
    return (
        v.contract_seasons.select("contract_id", "player", "season", "cap_figure")
        .join(v.players.select("player", "years_of_service"), "player")
        .join(F.broadcast(v.seasons.select("season", "non_taxpayer_mle")), "season")
        .select(
            "contract_id",
            R.arenas_applies(C("years_of_service")).alias("applies"),
            C("non_taxpayer_mle").alias("first_year_limit"),
            *R.arenas_fourth_year(C("cap_figure")),
        )
    )


@REG.add(
    "e16_trade_eligibility",
    """WITH x AS (SELECT contract_id, as_of + 120 AS on_date, signed_date AS d, flag, line_no,
   greatest(CAST(signed_date + INTERVAL 3 MONTH AS DATE), make_date(year(signed_date), 12, 15)) AS fa,
   greatest(CAST(signed_date + INTERVAL 3 MONTH AS DATE),
            make_date(year(signed_date) + CASE WHEN month(signed_date) >= 7 THEN 1 ELSE 0 END, 1, 15)) AS rs,
   signed_date + 30 AS rk FROM f_contract_seasons),
 y AS (SELECT *, CASE WHEN flag = 'R' AND on_date < rs THEN 're_signed_with_raise'
   WHEN flag = 'N' AND line_no <> 3 AND on_date < fa THEN 'free_agent_signing'
   WHEN line_no <= 2 AND on_date < rk THEN 'rookie_or_two_way_30_days' END AS reason FROM x)
 SELECT contract_id, reason IS NULL AS tradeable, reason,
 CAST(CASE reason WHEN 're_signed_with_raise' THEN rs WHEN 'free_agent_signing' THEN fa
      WHEN 'rookie_or_two_way_30_days' THEN rk END AS VARCHAR) AS eligible_from FROM y""",
)
def e16(v):
    e = R.trade_eligibility(
        F.date_add("as_of", 120), C("signed_date"), C("flag") == "R", C("flag") == "N",
        C("line_no") <= 2, C("line_no") == 3,
    )
    return v.contract_seasons.withColumn("e", e).select("contract_id", "e.*")


@REG.add(
    "e17_re_signed_applies",
    """SELECT contract_id, flag <> 'N' AND status = 'O' AND disc <= 8 AND
 cap_figure > (cap_figure - cap_figure * disc // 40) * 1.20::DOUBLE OR (flag <> 'N' AND status = 'O' AND disc <= 8 AND cap_figure > 1.20::DOUBLE * (cap_figure * tax // 8)) AS applies
 FROM f_lines""",
)
def e17(v):
    def applies(prior):
        return R.re_signed_applies(
            C("status") == "O", C("flag") != "N", C("cap_figure"), prior, C("disc") > 8
        )

    by_discount = C("cap_figure") - R.floor_div(C("cap_figure") * C("disc"), F.lit(40))
    by_tax = R.floor_div(C("cap_figure") * C("tax"), F.lit(8))
    return v.lines.select("contract_id", R.any_of(applies(by_discount), applies(by_tax)).alias("applies"))


@REG.add(
    "e18_trading_window",
    """WITH x AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, o_orderstatus, o_orderpriority FROM orders),
 y AS (SELECT *, CAST(make_date(year(d), 2, 15) AS DATE) AS game, make_date(year(d), 4, 14) AS last_game FROM x),
 z AS (SELECT *, game - (CASE WHEN (isodow(game) - 4 + 7) % 7 = 0 THEN 7 ELSE (isodow(game) - 4 + 7) % 7 END)::INTEGER - 7 AS deadline FROM y)
 SELECT o_orderkey AS order_id, CAST(CAST(deadline AS DATE) AS VARCHAR) AS deadline,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'moratorium' WHEN d > deadline AND d <= last_game THEN 'deadline_passed'
       WHEN d > last_game AND o_orderstatus = 'P' THEN 'postseason_roster' END AS reason,
  NOT (o_orderpriority = '1-URGENT' OR (d > deadline AND d <= last_game) OR (d > last_game AND o_orderstatus = 'P')) AS open FROM z""",
)
def e18(v):
    d = C("o_orderdate").cast("date")
    game = F.make_date(F.year(d), F.lit(2), F.lit(15))
    last = F.make_date(F.year(d), F.lit(4), F.lit(14))
    w = R.trading_window(
        d, game, last, C("o_orderpriority") == "1-URGENT", C("o_orderstatus") == "P"
    )
    return v.orders.withColumn("w", w).select(
        C("o_orderkey").alias("order_id"), R.deadline_for(game).alias("deadline"), "w.open", "w.reason"
    )


@REG.add(
    "e19_over_38",
    """SELECT contract_id, count(*) AS n_seasons, count(*) >= 4 AND max(y.season) - any_value(year(p.birth_date)) >= 38 AS over_38
 FROM f_years y JOIN f_players p ON p.player = y.player GROUP BY contract_id""",
)
def e19(v):
    return (
        v.years.groupBy("contract_id", "player")
        .agg(F.count("*").alias("n_seasons"), F.max("season").alias("last_season"))
        .join(v.players.select("player", F.year("birth_date").alias("birth_year")), "player")
        .select(
            "contract_id", "n_seasons",
            R.over_38(C("n_seasons"), C("last_season"), C("birth_year")).alias("over_38"),
        )
    )


@REG.add(
    "e20_age_on",
    """SELECT contract_id, year(as_of) - year(birth_date) - CASE WHEN (month(as_of), day(as_of)) >= (month(birth_date), day(birth_date)) THEN 0 ELSE 1 END AS age
 FROM f_contract_seasons c JOIN f_players p ON p.player = c.player""",
)
def e20(v):
    return (
        v.contract_seasons.select("contract_id", "player", "as_of")
        .join(v.players.select("player", "birth_date"), "player")
        .select("contract_id", R.age_on(C("birth_date"), C("as_of")).alias("age"))
    )


@REG.add(
    "e21_guaranteed_amount",
    """SELECT contract_id, season, guarantee_kind, CASE guarantee_kind WHEN 'full' THEN cap_figure WHEN 'none' THEN 0
 WHEN 'partial' THEN CASE WHEN k >= 3 THEN 0 ELSE cap_figure // 2 END END AS guaranteed FROM f_years""",
)
def e21(v):
    partial = F.when(C("k") < 3, R.floor_div(C("cap_figure"), F.lit(2)))
    return v.years.select(
        "contract_id", "season", "guarantee_kind",
        R.guaranteed_amount(C("guarantee_kind"), C("cap_figure"), partial).alias("guaranteed"),
    )


@REG.add(
    "e22_tpe_usable",
    """WITH x AS (SELECT e.*, greatest(0, amount - used) AS remaining, created + 200 AS on_date FROM f_exceptions e),
 y AS (SELECT *, year(on_date) - CASE WHEN month(on_date) < 7 THEN 1 ELSE 0 END AS season FROM x)
 SELECT contract_id, remaining, on_date <= expires AND remaining > 0 AS live,
  on_date <= expires AND remaining > 0 AND NOT (p.status = 'second_apron' AND year(created) < y.season) AS usable
 FROM y JOIN f_positions p ON p.team = y.team AND p.season = y.season""",
)
def e22(v):
    on = F.date_add("created", 200)
    x = v.exceptions.withColumn("season", R.season_start(on)).withColumn(
        "remaining", R.exception_remaining(C("amount"), C("used"))
    )
    live = R.exception_live(C("expires"), C("remaining"), on)
    return x.join(v.positions.select("team", "season", "status"), ["team", "season"]).select(
        "contract_id", "remaining", live.alias("live"),
        R.exception_usable(live, C("status"), C("created"), C("season")).alias("usable"),
    )


@REG.add(
    "e23_minimum_for",
    """SELECT player_key, years_of_service, m.minimum FROM f_players p
 JOIN (SELECT range AS yos, 1000000 + 150000 * range AS minimum FROM range(0, 11)) m ON m.yos = least(p.years_of_service, 10)""",
)
def e23(v):
    scale = v.spark.range(0, 11).select(
        C("id").alias("scale_year"), (C("id") * 150_000 + 1_000_000).alias("minimum")
    )
    return v.players.join(
        F.broadcast(scale), R.minimum_year(C("years_of_service"), F.lit(10)) == C("scale_year")
    ).select("player_key", "years_of_service", "minimum")


@REG.add(
    "e24_season_id",
    """SELECT o_orderkey AS order_id, (year(o_orderdate) - CASE WHEN month(o_orderdate) < 7 THEN 1 ELSE 0 END) || '-' ||
 (year(o_orderdate) + CASE WHEN month(o_orderdate) < 7 THEN 0 ELSE 1 END) AS season_id FROM orders""",
)
def e24(v):
    return v.orders.select(
        C("o_orderkey").alias("order_id"), R.season_id(C("o_orderdate").cast("date")).alias("season_id")
    )


@REG.add(
    "e25_binds_next_year",
    f"""SELECT team, season, row, CASE WHEN row BETWEEN 'E' AND 'J' THEN season + 1 ELSE season END AS binds_season
 FROM f_positions, {ROWS_SQL} WHERE NOT ({PERMITTED})""",
)
def e25(v):
    p = v.positions
    return p.select("team", "season", _rows(p)).where("not permitted").select(
        "team", "season", "row",
        F.when(R.binds_next_year(C("row")), C("season") + 1).otherwise(C("season")).alias("binds_season"),
    )


@REG.add(
    "e26_roster_flags",
    """SELECT p.team, p.season, standard_count, coalesce(t.n, 0) AS two_way_count, standard_count > 15 AS over_standard_max,
 standard_count < 14 AS below_standard_min, coalesce(t.n, 0) > 3 AS over_two_way_max,
 greatest(0, 15 - standard_count) AS open_standard_slots
 FROM f_positions p LEFT JOIN (SELECT team, season, count(*) AS n FROM f_holds WHERE label = 'Two-Way' GROUP BY ALL) t
 ON t.team = p.team AND t.season = p.season""",
)
def e26(v):
    two_way = (
        v.holds.where("label = 'Two-Way'").groupBy("team", "season").agg(F.count("*").alias("n"))
    )
    return (
        v.positions.select("team", "season", "standard_count")
        .join(two_way, ["team", "season"], "left")
        .withColumn("two_way_count", F.coalesce("n", F.lit(0)))
        .select(
            "team", "season", "standard_count", "two_way_count",
            *R.roster_flags(C("standard_count"), C("two_way_count"), RULES),
        )
    )
