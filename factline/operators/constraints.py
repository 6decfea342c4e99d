"""What limits a team, with no trade proposed. Every report is long: one row per constraint."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factline.functions import rules as R
from factline.operators.trades import active_restrictions

COLUMNS = ["team", "season", "player", "kind", "value", "blocking"]


def _rows(df: DataFrame, kind, value=None, blocking=None, player: bool = False) -> DataFrame:
    kind = kind if isinstance(kind, Column) else F.lit(kind)
    return df.select(
        "team",
        "season",
        (F.col("player") if player else F.lit(None).cast("bigint")).alias("player"),
        kind.alias("kind"),
        (F.lit(None) if value is None else value).cast("bigint").alias("value"),
        (F.lit(False) if blocking is None else blocking).alias("blocking"),
    )


# -- teams -----------------------------------------------------------------


def hard_cap(positions: DataFrame, ceilings: DataFrame) -> DataFrame:
    """The binding ceiling with its headroom, the ones it supersedes, or none at all."""
    room = F.col("ceiling_amount") - F.col("apron_salary")
    binding = _rows(
        positions.where("ceiling_amount is not null"), "hard_cap", room, room <= 0
    )
    none = _rows(positions.where("ceiling_amount is null"), "no_hard_cap")
    extra = ceilings.withColumn(
        "r", F.row_number().over(W.partitionBy("team", "season").orderBy("level"))
    ).where("r > 1")
    superseded = _rows(
        positions.select("team", "season").join(extra, ["team", "season"]), "hard_cap_superseded"
    )
    return binding.unionByName(none).unionByName(superseded)


def apron_rows(positions: DataFrame, rules: R.RuleSet = R.RuleSet()) -> DataFrame:
    rows = R.restriction_rows(
        F.col("apron_salary"), F.col("first_apron"), F.col("second_apron"), F.col("season_id"),
        rules, True,
    )
    barred = positions.withColumn("rows", F.filter(rows, lambda r: ~r["permitted"]))
    some = barred.select("team", "season", F.explode("rows").alias("r")).select(
        "team", "season", F.concat(F.lit("apron_row_"), F.col("r.row")).alias("k"), "r.level_amount"
    )
    return _rows(some, F.col("k"), F.col("level_amount")).unionByName(
        _rows(barred.where(F.size("rows") == 0), "no_apron_restriction")
    )


def roster(positions: DataFrame, rules: R.RuleSet = R.RuleSet()) -> DataFrame:
    count = F.col("standard_count")
    spare = count - rules.standard_min
    low = _rows(
        positions, F.when(spare <= 0, "roster_minimum").otherwise("roster_spare"),
        F.when(spare <= 0, count).otherwise(spare),
    )
    full = _rows(positions.where(count >= rules.standard_max), "roster_maximum", count)
    return low.unionByName(full)


# -- picks -----------------------------------------------------------------


def pick_years(picks: DataFrame) -> DataFrame:
    """Every year a team's inventory spans, whether it holds a first then, and whether all
    it holds could fail to convey. A span is a handful of years per team."""
    inventory = picks.select(
        "year", F.explode(F.array_distinct(F.array("original_team", "owner"))).alias("team")
    )
    span = inventory.groupBy("team").agg(F.min("year").alias("a"), F.max("year").alias("b"))
    years = span.select("team", F.explode(F.sequence("a", "b")).alias("year"))
    conveyed = (F.col("owner") != F.col("original_team")) & (F.col("protected_to") > 0)
    held = (
        picks.where("not forfeited")
        .groupBy(F.col("owner").alias("team"), "year")
        .agg(F.lit(True).alias("held"), F.bool_and(conveyed).alias("lost"))
    )
    return years.join(held, ["team", "year"], "left").select(
        "team",
        "year",
        F.coalesce("held", F.lit(False)).alias("held"),
        F.coalesce("lost", F.lit(False)).alias("lost"),
    )


def consecutive_gaps(years: DataFrame) -> DataFrame:
    """The first two consecutive years without a first, per team; null when there is none.

    years: team, year, bare.
    """
    w = W.partitionBy("team").orderBy("year")
    pair = F.when(F.col("bare") & F.lead("bare", 1, False).over(w), F.col("year"))
    return (
        years.withColumn("pair", pair)
        .groupBy("team")
        .agg(F.count_if("bare").alias("n_bare"), F.min("pair").alias("gap_from"))
        .withColumn("gap_to", F.col("gap_from") + 1)
        .withColumn("permitted", F.col("gap_from").isNull())
    )


def tradeable_years(years: DataFrame) -> DataFrame:
    """Per held year: would trading that first leave two consecutive years without one?

    Barred when the team has a gap pair already, or a neighbouring year in its span is bare.
    """
    w = W.partitionBy("team").orderBy("year")
    bare = ~F.col("held")
    whole = W.partitionBy("team")
    pair = bare & F.lead(bare, 1, False).over(w)
    return (
        years.withColumn("beside", F.lag(bare, 1, False).over(w) | F.lead(bare, 1, False).over(w))
        .withColumn("pair", pair)
        .withColumn("has_pair", F.max("pair").over(whole))
        .where("held")
        .select("team", "year", (~(F.col("has_pair") | F.col("beside"))).alias("tradeable"))
    )


def pick_conveys(picks: DataFrame, slots: DataFrame, protections: DataFrame) -> DataFrame:
    """Slots at which a pick conveys: not forfeited, and in no protected range.

    slots (original_team, year, slot), protections (original_team, year, low, high).
    """
    alive = picks.where("not forfeited").select("original_team", "year", "owner")
    asked = slots.join(alive, ["original_team", "year"])
    p = protections.select(
        F.col("original_team").alias("p_team"), F.col("year").alias("p_year"), "low", "high"
    )
    inside = (
        (asked["original_team"] == p["p_team"])
        & (asked["year"] == p["p_year"])
        & asked["slot"].between(p["low"], p["high"])
    )
    return asked.join(p, inside, "left_anti")


# -- players ---------------------------------------------------------------


def under_contract(asked: DataFrame, held: DataFrame) -> DataFrame:
    """Questions with the contract each is about, and whether there is one: what the reports below have in common."""
    return asked.join(held, ["team", "season", "player"], "left").withColumn("known", F.col("contract_id").isNotNull())


def _all_of(asked: DataFrame, held: DataFrame | None) -> DataFrame:
    """Every question; without `held`, `asked` is what `under_contract` gives."""
    return asked if held is None else under_contract(asked, held)


def _known_of(asked: DataFrame, held: DataFrame | None) -> DataFrame:
    return asked.where("known") if held is None else asked.join(held, ["team", "season", "player"])


def restrictions(asked: DataFrame, limits: DataFrame, on: Column) -> DataFrame:
    q = asked.withColumn("when", on)
    r = limits.withColumnRenamed("player", "r_player")
    hit = q.join(r, (q["player"] == r["r_player"]) & active_restrictions("when"))
    return _rows(
        hit,
        F.when(F.col("blocks_trade"), "may_not_be_traded").otherwise("may_not_be_aggregated"),
        None,
        F.col("blocks_trade"),
        True,
    )


def player_terms(asked: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """Unknown player, unknown kicker or known kicker."""
    q = _all_of(asked, held)
    kind = (
        F.when(~F.col("known"), "unknown_player")
        .when(F.col("kicker_state") == "unknown", "unknown_trade_kicker")
        .when(F.col("kicker_state") == "known", "trade_kicker")
    )
    return _rows(q.where(kind.isNotNull()), kind, None, ~F.col("known"), True)


def no_trade_clause(asked: DataFrame, held: DataFrame | None = None) -> DataFrame:
    q = _known_of(asked, held).where("ntc_state <> 'absent'")
    known = F.col("ntc_state") == "known"
    return _rows(
        q, F.when(known, "no_trade_clause").otherwise("unknown_no_trade_clause"), None, known, True
    )


def trade_window(asked: DataFrame, held: DataFrame | None, on: Column) -> DataFrame:
    """Whether a waiting period is still running; no signing date means it cannot be told."""
    q = _all_of(asked, held).withColumn("when", on)
    rookie = F.col("contract_type").isin("rookie_first_round", "rookie_second_round")
    e = R.trade_eligibility(
        F.col("when"), F.col("signed_date"), F.lit(False), F.lit(False), rookie,
        F.col("contract_type") == "sign_and_trade",
    )
    undated = F.col("signed_date").isNull()
    kind = (
        F.when(undated, "signing_date_unknown")
        .when(~F.col("e.tradeable"), "trade_window")
        .otherwise("flags_not_carried")
    )
    return _rows(q.withColumn("e", e), kind, None, ~undated & ~F.col("e.tradeable"), True)


def capacity(asked: DataFrame, held: DataFrame | None, positions: DataFrame, base_cap: int) -> DataFrame:
    """How much the team could take back for this player alone."""
    q = _known_of(asked, held).join(positions, ["team", "season"])
    cush = R.cushion(F.col("apron_salary"), F.col("first_apron"))
    value = F.greatest(
        R.allow_standard(F.col("cap_figure"), cush),
        R.allow_expanded(F.col("cap_figure"), cush, F.col("salary_cap"), R.big(base_cap)),
    )
    return _rows(q, "take_back_capacity", value, None, True)


ASSUMPTIONS = {
    "unknown_trade_kicker", "unknown_no_trade_clause", "signing_date_unknown", "flags_not_carried",
}


def report(parts: list[DataFrame]) -> DataFrame:
    """All constraints as one long table."""
    return reduce(DataFrame.unionByName, parts).select(*COLUMNS)


def summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("team", "season").agg(
        F.count("*").alias("n_constraints"),
        F.count_if("blocking").alias("n_blocking"),
        F.count_if(F.col("kind").isin(*sorted(ASSUMPTIONS))).alias("n_assumptions"),
    )
