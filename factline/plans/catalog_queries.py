"""Catalog entities and the typed query over them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factline.operators import catalog as cat
from factline.operators import goldens, ingest, matching, provenance, query
from factline.operators.query import Filter, Order, Projection, Query
from factline.plans.registry import Registry

REG = Registry()
C = F.col


def season_rows(v) -> DataFrame:
    """Thresholds of the seasons that occur in the orders."""
    season = F.year(F.add_months(C("o_orderdate").cast("date"), -6)).cast("bigint")
    return v.orders.select(season.alias("season")).distinct().join(F.broadcast(v.seasons), "season")


def catalog(v) -> cat.Catalog:
    return cat.Catalog.of(
        cat.contract_seasons(lambda: v.contract_seasons, lambda: v.players),
        cat.cap_holds(
            lambda: v.holds.withColumnRenamed("kind", "line_kind"),
            lambda: v.players.where("size < 50").drop("kind"),
        ),
        cat.hard_cap_ceilings(lambda: v.ceilings),
        cat.draft_picks(lambda: v.picks),
        cat.trade_exceptions(lambda: v.exceptions),
        cat.awards(lambda: v.awards, lambda: v.players),
        cat.seasons(lambda: season_rows(v)),
        cat.Entity(
            "events",
            lambda: v.events.withColumn("day", C("ts").cast("date")),
            (
                cat.text("event_type"),
                cat.integer("user_id"),
                cat.Field("value", "real", C("value")),
                cat.date("day"),
            ),
            "Raw observations",
            C("event_type"),
            F.when((C("event_type") != "error") & (C("value") >= 10), C("ts").cast("date")),
        ),
    )


def source_dates(v) -> DataFrame:
    """When each source was last read; errors and clicks have no record of it."""
    return (
        v.events.where("event_type not in ('error', 'click')")
        .groupBy(C("event_type").alias("source"))
        .agg(F.max(C("ts").cast("date")).cast("string").alias("scraped"))
    )


def P(field, agg=None, alias=None):
    return Projection(field, agg, alias)


HOLDS = """
SELECT coalesce(p.display_name, CAST(h.player AS VARCHAR)) AS player, h.team, h.amount, h.label AS bird_rights,
 CASE WHEN h.label LIKE 'Restricted%' THEN 'qualifying_offer' WHEN h.label = '1st Round Pick' THEN 'draft_pick'
      WHEN h.label = 'Two-Way' THEN 'two_way' ELSE 'free_agent' END AS kind,
 CASE WHEN h.offer <> 0 THEN h.offer END AS qualifying_offer, h.season
FROM f_holds h LEFT JOIN (SELECT * FROM f_players WHERE size < 50) p ON p.player = h.player"""
CONTRACTS = """
SELECT p.display_name AS player, p.player_key, c.team, c.season_id AS season, c.cap_figure AS salary, c.option_kind, c.guarantee_kind,
 c.contract_type, CAST(c.signed_date AS VARCHAR) AS signed_date, p.years_of_service
FROM f_contract_seasons c JOIN f_players p ON p.player = c.player"""
CEILINGS = "SELECT team, season_id AS season, level AS apron_level, category AS trigger_category, detail AS trigger_detail FROM f_ceilings"
PICKS = """SELECT year, round, owner AS team, original_team, CAST(forfeited AS BIGINT) AS forfeited,
 CASE WHEN protected_to > 0 THEN 'protected 1-' || protected_to END AS protection_text FROM f_picks"""
EXCEPTIONS = """SELECT team, amount, amount - used AS available, CAST(expires AS VARCHAR) AS expires, kind,
 contract_id AS reason FROM f_exceptions"""
AWARDS = """SELECT coalesce(p.display_name, CAST(a.player AS VARCHAR)) AS player, season, award, tier
 FROM f_awards a LEFT JOIN f_players p ON p.player = a.player"""
SEASONS = """SELECT season_id AS season, salary_cap, tax_level, first_apron, second_apron, non_taxpayer_mle, taxpayer_mle
 FROM f_seasons WHERE season IN (SELECT year(o_orderdate) - CASE WHEN month(o_orderdate) < 7 THEN 1 ELSE 0 END FROM orders)"""

ENTITY_SQL = {
    "c02_contract_seasons": ("contract_seasons", CONTRACTS),
    "c03_cap_holds": ("cap_holds", HOLDS),
    "c04_hard_cap_ceilings": ("hard_cap_ceilings", CEILINGS),
    "c05_draft_picks": ("draft_picks", PICKS),
    "c06_trade_exceptions": ("trade_exceptions", EXCEPTIONS),
    "c07_awards": ("awards", AWARDS),
    "c08_seasons": ("seasons", SEASONS),
}


def _entity(name):
    return lambda v: catalog(v).entities[name].select_all()


for _key, (_name, _sql) in ENTITY_SQL.items():
    REG.add(_key, _sql)(_entity(_name))


@REG.add(
    "c01_entity_fields",
    f"SELECT player_key, salary FROM ({CONTRACTS})",
)
def c01(v):
    """Two fields of a wide view: everything else is pruned before the scan."""
    return catalog(v).entities["contract_seasons"].select_all().select("player_key", "salary")


@REG.add(
    "c09_describe_catalog",
    " UNION ALL ".join(
        f"SELECT '{n}' AS entity, {k}::BIGINT AS n_fields, count(*) AS n_rows FROM ({s})"
        for (n, s), k in zip(ENTITY_SQL.values(), (10, 7, 5, 6, 6, 4, 7))
    ),
)
def c09(v):
    """The catalog as data, with the size each entity has today."""
    ents = [e for e in catalog(v).entities.values() if e.name != "events"]
    counts = [
        e.frame.agg(F.count("*").alias("n_rows")).withColumn("entity", F.lit(e.name)) for e in ents
    ]
    fields = catalog(v).describe(v.spark).groupBy("entity").agg(F.count("*").alias("n_fields"))
    return reduce(DataFrame.unionByName, counts).join(fields, "entity")


def planned(name: str, q: Query, sql: str):
    REG.add(name, sql)(lambda v: q.plan(catalog(v)))


planned(
    "c11_projection",
    Query("draft_picks", (P("year"), P("forfeited", "sum"), P("team", "count", "n")), group_by=("year",)),
    f"SELECT year, CAST(sum(forfeited) AS BIGINT) AS sum_forfeited, count(team) AS n FROM ({PICKS}) GROUP BY year",
)
planned(
    "c12_comparison_filters",
    Query(
        "contract_seasons",
        (P("team"), P("*", "count", "n"), P("salary", "sum", "total")),
        (
            Filter("salary", "gte", 5_000_000),
            Filter("salary", "lt", 9_000_000),
            Filter("season", "ne", "1999-2000"),
            Filter("option_kind", "eq", "team"),
            Filter("years_of_service", "gt", 2),
            Filter("years_of_service", "lte", 10),
        ),
        group_by=("team",),
    ),
    f"""SELECT team, count(*) AS n, CAST(sum(salary) AS BIGINT) AS total FROM ({CONTRACTS})
 WHERE salary >= 5000000 AND salary < 9000000 AND season <> '1999-2000' AND option_kind = 'team'
 AND years_of_service > 2 AND years_of_service <= 10 GROUP BY team ORDER BY team NULLS FIRST""",
)
planned(
    "c13_in_list",
    Query(
        "contract_seasons",
        (P("season"), P("contract_type"), P("*", "count", "n")),
        (Filter("contract_type", "in", ["sign_and_trade", "unknown"]), Filter("season", "in", ["1996-1997", "1999-2000"])),
        group_by=("season", "contract_type"),
    ),
    f"""SELECT season, contract_type, count(*) AS n FROM ({CONTRACTS}) WHERE contract_type IN ('sign_and_trade', 'unknown')
 AND season IN ('1996-1997', '1999-2000') GROUP BY ALL""",
)
planned(
    "c14_contains",
    Query(
        "contract_seasons",
        (P("player"), P("*", "count", "n"), P("salary", "max")),
        (Filter("player", "contains", "R_N"),),
        group_by=("player",),
    ),
    f"""SELECT player, count(*) AS n, max(salary) AS max_salary FROM ({CONTRACTS}) WHERE player ILIKE '%R_N%' GROUP BY player""",
)
planned(
    "c15_is_null",
    Query(
        "contract_seasons",
        (P("team"), P("*", "count", "n")),
        (Filter("option_kind", "is_null"), Filter("signed_date", "not_null")),
        group_by=("team",),
        order_by=(Order("team"),),
    ),
    f"""SELECT team, count(*) AS n FROM ({CONTRACTS}) WHERE option_kind IS NULL AND signed_date IS NOT NULL
 GROUP BY team ORDER BY team""",
)
planned(
    "c16_aggregates",
    Query(
        "contract_seasons",
        (
            P("season"), P("*", "count", "n"), P("option_kind", "count"), P("player_key", "count_distinct"),
            P("salary", "sum"), P("salary", "avg"), P("salary", "min"), P("salary", "max"),
            P("signed_date", "min"),
        ),
        group_by=("season",),
    ),
    f"""SELECT season, count(*) AS n, count(option_kind) AS count_option_kind, count(DISTINCT player_key) AS count_distinct_player_key,
 CAST(sum(salary) AS BIGINT) AS sum_salary, avg(salary) AS avg_salary, min(salary) AS min_salary, max(salary) AS max_salary,
 min(signed_date) AS min_signed_date FROM ({CONTRACTS}) GROUP BY season""",
)
planned(
    "c17_group_by",
    Query("contract_seasons", (P("option_kind"), P("contract_type")), group_by=("option_kind", "contract_type")),
    f"SELECT DISTINCT option_kind, contract_type FROM ({CONTRACTS})",
)
planned(
    "c18_order_by",
    Query(
        "trade_exceptions",
        (P("reason"), P("available"), P("expires")),
        order_by=(Order("expires"), Order("available", True), Order("reason")),
    ),
    f"SELECT reason, available, expires FROM ({EXCEPTIONS}) ORDER BY expires NULLS FIRST, available DESC NULLS LAST, reason",
)
FLAGSHIP = Query(
    "contract_seasons",
    (P("team"), P("salary", "sum", "committed"), P("*", "count", "n")),
    (Filter("season", "eq", "1999-2000"),),
    group_by=("team",),
    order_by=(Order("committed", True), Order("team")),
    limit=10,
)
FLAGSHIP_SQL = f"""SELECT team, CAST(sum(salary) AS BIGINT) AS committed, count(*) AS n FROM ({CONTRACTS})
 WHERE season = '1999-2000' GROUP BY team ORDER BY committed DESC, team LIMIT 10"""
planned("c19_limit", FLAGSHIP, FLAGSHIP_SQL)


@REG.add(
    "c20_bound_parameters",
    f"""SELECT player, count(*) AS n FROM ({CONTRACTS}) WHERE player <> 'red'' widget; --' AND player IN ('red ring', 'x'' OR ''1''=''1', 'hot plate') GROUP BY player""",
)
def c20(v):
    """Values are literals of the plan, whatever is in them; no text is pasted together."""
    q = Query(
        "contract_seasons",
        (P("player"), P("*", "count", "n")),
        (
            Filter("player", "ne", "red' widget; --"),
            Filter("player", "in", ["red ring", "x' OR '1'='1", "hot plate"]),
        ),
        group_by=("player",),
    )
    return query.run(catalog(v), q, source_dates(v)).df


BASIS = """WITH x AS (SELECT event_type AS source, CASE WHEN event_type <> 'error' AND value >= 10 THEN CAST(ts AS DATE) END AS d
  FROM events {where}),
 s AS (SELECT source, count(*) AS total, count(d) AS dated, min(d) AS lo, max(d) AS hi FROM x GROUP BY source),
 r AS (SELECT event_type AS source, CAST(max(CAST(ts AS DATE)) AS VARCHAR) AS scraped FROM events WHERE event_type NOT IN ('error', 'click') GROUP BY 1),
 o AS (SELECT source, dated AS rows, 'row' AS basis, CAST(lo AS VARCHAR) AS earliest, CAST(hi AS VARCHAR) AS latest FROM s WHERE dated > 0
 UNION ALL SELECT s.source, total - dated, CASE WHEN scraped IS NULL THEN 'undated' ELSE 'scraped' END, scraped, scraped
 FROM s LEFT JOIN r ON r.source = s.source WHERE total > dated)"""
EVENTS = Query("events", (P("event_type"), P("*", "count", "n")), (Filter("value", "gt", 1.5),), ("event_type",), limit=3)


@REG.add(
    "c21_run",
    f"""SELECT r.*, s.sources FROM ({FLAGSHIP_SQL}) r, (SELECT string_agg(DISTINCT source, '|' ORDER BY source) AS sources
 FROM f_contract_seasons WHERE season_id = '1999-2000') s""",
)
def c21(v):
    """The result together with the sources its rows came from."""
    out = query.run(catalog(v), FLAGSHIP, source_dates(v))
    sources = out.provenance.agg(
        F.array_join(F.array_sort(F.collect_set("source")), "|").alias("sources")
    )
    return out.df.withColumn("k", F.lit(1)).join(sources.withColumn("k", F.lit(1)), "k").drop("k")


@REG.add("c22_observe", BASIS.format(where="WHERE value > 1.5") + " SELECT * FROM o")
def c22(v):
    return provenance.observe(catalog(v), EVENTS, source_dates(v))


@REG.add(
    "c23_provenance_text",
    BASIS.format(where="")
    + """ SELECT source, basis, CASE WHEN basis = 'undated' THEN source || ', date unknown (' || rows || ' rows)'
 ELSE source || ', ' || CASE basis WHEN 'scraped' THEN 'scraped ' ELSE 'as of ' END || earliest ||
 CASE WHEN latest <> earliest THEN ' to ' || latest ELSE '' END || ' (' || rows || ' rows)' END AS text FROM o""",
)
def c23(v):
    e = catalog(v).entities["events"]
    return provenance.describe(
        provenance.observed(e.frame, e.source, e.as_of, source_dates(v))
    ).select("source", "basis", "text")


@REG.add(
    "c24_snapshot",
    """SELECT CAST(max(CAST(o_orderdate AS DATE)) AS VARCHAR) AS built_at, '2000-2001' AS season,
 (SELECT '{' || string_agg('"' || source || '":"' || scraped || '"', ',' ORDER BY source) || '}' FROM
 (SELECT event_type AS source, CAST(max(CAST(ts AS DATE)) AS VARCHAR) AS scraped FROM events WHERE event_type NOT IN ('error', 'click') GROUP BY 1)) AS source_dates
 FROM orders""",
)
def c24(v):
    built = v.orders.agg(F.max(C("o_orderdate").cast("date")).cast("string").alias("built_at"))
    meta = ingest.build_meta(built, "2000-2001", source_dates(v))
    return provenance.snapshot(meta)


@REG.add("c25_lookup", "SELECT * FROM f_lookup")
def c25(v):
    return matching.lookup(v.requests, v.named_players, 8)


@REG.add(
    "c26_resolve_entities",
    """SELECT r.request, count(l.player_key) AS n_candidates, CASE WHEN count(l.player_key) = 1 THEN min(l.player_key) END AS resolved,
 CASE WHEN count(l.player_key) > 1 THEN string_agg(l.player_key, '|' ORDER BY l.rank) END AS choices
 FROM f_requests r LEFT JOIN f_lookup l ON l.request = r.request GROUP BY r.request""",
)
def c26(v):
    return matching.resolve_entities(v.requests, matching.lookup(v.requests, v.named_players, 8))


@REG.add(
    "c27_results_equal",
    """SELECT 'same' AS case_name, CAST(0 AS BIGINT) AS only_left, CAST(0 AS BIGINT) AS only_right, true AS equal
 UNION ALL SELECT 'differs', a, b, a = 0 AND b = 0 FROM (
  SELECT count(*) FILTER (NOT EXISTS (SELECT 1 FROM r WHERE r.k = l.k)) AS a, (SELECT count(*) FROM r WHERE NOT EXISTS (SELECT 1 FROM l2 WHERE l2.k = r.k)) AS b FROM l)""".replace(
        "SELECT 'same'",
        """WITH l AS (SELECT s_suppkey || '/' || count(*) AS k FROM supplier JOIN lineitem ON l_suppkey = s_suppkey GROUP BY s_suppkey),
 l2 AS (SELECT * FROM l),
 r AS (SELECT s_suppkey || '/' || count(*) AS k FROM supplier JOIN lineitem ON l_suppkey = s_suppkey WHERE l_tax < 0.08 GROUP BY s_suppkey)
 SELECT 'same'""",
        1,
    ),
)
def c27(v):
    a = Query("contract_seasons", (P("team"), P("*", "count", "n")), group_by=("team",))
    cat_ = catalog(v)
    left = a.filtered(cat_).groupBy("team").agg(F.count("*").alias("n"))
    same = v.lineitem.groupBy(C("l_suppkey").alias("holder")).agg(F.count("*").alias("held"))
    other = v.lineitem.where("l_tax < 0.08").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    return (
        matching.results_equal(left, same.select("held", "holder")).withColumn("case_name", F.lit("same"))
        .unionByName(matching.results_equal(left, other).withColumn("case_name", F.lit("differs")))
    )


GOLDENS = [
    goldens.Golden(
        "holds listed", "holds",
        Query("cap_holds", (P("*", "count", "n"),)), None, 1, None,
    ),
    goldens.Golden(
        "largest contract", "salary",
        Query("contract_seasons", (P("salary", "max"),)), None, 0, 20_000_000,
    ),
    goldens.Golden(
        "players under option", "salary",
        Query(
            "contract_seasons", (P("player_key", "count_distinct", "n"),),
            (Filter("option_kind", "eq", "player"),),
        ),
        None, 5, None,
    ),
    goldens.Golden(
        "first-apron ceilings", "ceilings",
        Query("hard_cap_ceilings", (P("*", "count", "n"),), (Filter("apron_level", "eq", "first_apron"),)),
        None, 0, None,
    ),
    goldens.Golden(
        "picks forfeited", "picks",
        Query("draft_picks", (P("forfeited", "sum"),)), None, None, 0,
    ),
    goldens.Golden(
        "unknown field", "salary", Query("contract_seasons", (P("agent"),)),
    ),
    goldens.Golden("is the trade legal", "rules"),
]


@REG.add(
    "c28_run_goldens",
    f"""WITH r(name, category, outcome) AS (
 SELECT 'holds listed', 'holds', CASE WHEN count(*) >= 1 THEN 'pass' ELSE 'fail' END FROM f_holds
 UNION ALL SELECT 'largest contract', 'salary', CASE WHEN max(cap_figure) BETWEEN 0 AND 20000000 THEN 'pass' ELSE 'fail' END FROM f_contract_seasons
 UNION ALL SELECT 'players under option', 'salary', CASE WHEN count(DISTINCT player) >= 5 THEN 'pass' ELSE 'fail' END FROM f_contract_seasons WHERE option_kind = 'player'
 UNION ALL SELECT 'first-apron ceilings', 'ceilings', CASE WHEN count(*) >= 0 THEN 'pass' ELSE 'fail' END FROM f_ceilings WHERE level = 'first_apron'
 UNION ALL SELECT 'picks forfeited', 'picks', CASE WHEN sum(forfeited::INT) <= 0 THEN 'pass' ELSE 'fail' END FROM f_picks
 UNION ALL SELECT 'unknown field', 'salary', 'errored' UNION ALL SELECT 'is the trade legal', 'rules', 'gap')
 SELECT category, count(*) FILTER (outcome = 'pass') AS n_pass, count(*) FILTER (outcome = 'fail') AS n_fail,
 count(*) FILTER (outcome = 'errored') AS n_errored, count(*) FILTER (outcome = 'gap') AS n_gap FROM r GROUP BY category""",
)
def c28(v):
    return goldens.tally(goldens.run_goldens(v.spark, catalog(v), GOLDENS))
