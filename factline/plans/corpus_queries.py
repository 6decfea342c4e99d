"""The trade corpus: parsing, evaluation, mutants and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from factline.operators import corpus as G
from factline.plans.registry import Registry
from factline.plans.views import BASE_CAP, RULES
from factline.sources import scratch

REG = Registry()
C = F.col
MIN_SEASON = "1996-1997"
CODE = r"T\d+"


def text(v):
    """The corpus as it would be read from files: written once, then parsed."""
    v.keep("leg_text")
    return v.of("leg_text")


def cases(v):
    return G.build_cases(G.parse_legs(text(v)), MIN_SEASON)


def sent(v, built=None):
    return G.reconstruct_outgoing(
        cases(v) if built is None else built,
        G.incoming_by_source(text(v), CODE),
        F.concat(F.lit("T"), C("team").cast("string")),
    )


#: What checks, mutants and scores read of a case; other facts of a text don't move with it.
READ = ("trade_id", "team", "season_id", "incoming", "outgoing", "n_legs", "balanced")


def legs(v):
    """Every leg with its capacity. Cases, what was sent, and the result are each read by
    several branches, so each is written once."""
    built = scratch.written(cases(v).select(*READ), "cases")
    moved = scratch.written(sent(v, built), "sent")
    full = G.with_capacity(built, moved, v.seasons, BASE_CAP)
    return scratch.written(full, "corpus-legs")


@REG.add(
    "g01_parse_legs",
    """SELECT trade_id, CAST(date AS VARCHAR) AS date, team, incoming, outgoing, cash_received, picks, generated_tpe, array_to_string(incoming_salaries, '|') AS incoming_salaries FROM f_parsed""",
)
def g01(v):
    return G.parse_legs(v.leg_text).withColumn(
        "incoming_salaries", F.array_join(C("incoming_salaries").cast("array<string>"), "|")
    )


@REG.add(
    "g02_incoming_by_source",
    """SELECT m.trade_id, m.to_team AS team, CASE WHEN n.n > 2 THEN 'T' || m.from_team END AS source, string_agg(CAST(m.amount AS VARCHAR), '|' ORDER BY m.contract_id) AS salaries
 FROM f_valid_moves m JOIN (SELECT trade_id, count(DISTINCT from_team) AS n FROM f_valid_moves GROUP BY 1) n ON n.trade_id = m.trade_id GROUP BY m.trade_id, m.to_team, n.n, m.from_team""",
)
def g02(v):
    b = G.incoming_by_source(v.leg_text, CODE).where(F.size("salaries") > 0)
    return b.withColumn("salaries", F.array_join(C("salaries").cast("array<string>"), "|"))


@REG.add("g03_build_cases", "SELECT trade_id, team, season_id, n_legs FROM f_cases")
def g03(v):
    return cases(v).select("trade_id", "team", "season_id", "n_legs")


@REG.add("g04_balanced", "SELECT DISTINCT trade_id, balanced FROM f_cases")
def g04(v):
    return cases(v).select("trade_id", "balanced").distinct()


@REG.add(
    "g05_reconstruct_outgoing",
    """SELECT c.trade_id, c.team, CAST(sum(s.amount) AS BIGINT) AS sent_total, count(*) AS n_sent, CAST(sum(s.amount) AS BIGINT) = c.outgoing AS reconstructed
 FROM f_cases c JOIN f_sent s ON s.trade_id = c.trade_id AND s.team = c.team GROUP BY c.trade_id, c.team, c.outgoing""",
)
def g05(v):
    sums = sent(v).groupBy("trade_id", "team").agg(
        F.sum("amount").alias("sent_total"), F.count("*").alias("n_sent")
    )
    return cases(v).join(sums, ["trade_id", "team"]).select(
        "trade_id", "team", "sent_total", "n_sent", (C("sent_total") == C("outgoing")).alias("reconstructed")
    )


@REG.add("g06_evaluate_cases", 'SELECT trade_id, team, "check", outcome FROM f_checks')
def g06(v):
    return G.evaluate_cases(legs(v), RULES)


@REG.add(
    "g07_tally",
    """SELECT "check", count(*) FILTER (outcome = 'pass') AS n_pass, count(*) FILTER (outcome = 'fail') AS n_fail, count(*) FILTER (outcome = 'skipped') AS n_skipped FROM f_checks GROUP BY 1""",
)
def g07(v):
    return G.tally(G.evaluate_cases(legs(v), RULES))


@REG.add("g08_failures", """SELECT trade_id, team, "check", outcome FROM f_checks WHERE outcome = 'fail'""")
def g08(v):
    return G.failures(G.evaluate_cases(legs(v), RULES))


@REG.add("g09_mutants", "SELECT trade_id, team, outgoing, capacity, kind, mutated FROM f_mutants")
def g09(v):
    return G.mutants(legs(v))


@REG.add(
    "g10_score",
    """WITH t AS (SELECT trade_id, sum(incoming) AS total_in, sum(outgoing) AS total_out FROM f_capacity GROUP BY 1),
 f AS (SELECT m.kind, CASE WHEN m.kind <> 'unbalance' THEN CASE WHEN m.outgoing <= 0 OR m.mutated > m.capacity THEN 'no_exception_available' END
   WHEN t.total_in - l.incoming + m.mutated <> t.total_out THEN 'unbalanced' END AS code FROM f_mutants m JOIN f_capacity l ON l.trade_id = m.trade_id AND l.team = m.team JOIN t ON t.trade_id = m.trade_id),
 m AS (SELECT count(*) AS n_mutants, count(code) AS detected, count(*) FILTER (code = CASE kind WHEN 'unbalance' THEN 'unbalanced' ELSE 'no_exception_available' END) AS right_reason FROM f),
 r AS (SELECT count(*) FILTER (incoming > outgoing AND outgoing > 0 AND incoming > capacity) AS undeterminable FROM f_capacity WHERE balanced AND salary_cap IS NOT NULL)
 SELECT n_mutants, detected, right_reason, undeterminable, round(coalesce(detected / nullif(n_mutants, 0), 0), 6) AS recall,
 round(coalesce(detected / nullif(detected + undeterminable, 0), 0), 6) AS precision_floor, round(coalesce(right_reason / nullif(detected, 0), 0), 6) AS reason_accuracy FROM m, r""",
)
def g10(v):
    corpus = legs(v)
    return G.score(G.mutants(corpus), corpus)
