"""Proposed trades: shape checks, legs, rules and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factline.functions import constants as K
from factline.functions import rules as R


def _shape_error(max_moves: int | None) -> Column:
    """The first thing wrong, of a trade's n_moves, lo, hi, n_self and n_players."""
    return (
        F.when(F.lit(False) if max_moves is None else F.col("n_moves") > max_moves, "too_many_moves")
        .when(F.col("lo") == F.col("hi"), "one_team")
        .when(F.col("n_self") > 0, "self_move")
        .when(F.col("n_players") < F.col("n_moves"), "player_twice")
    )


def trade_errors(moves: DataFrame, max_moves: int | None = None) -> DataFrame:
    """One row per trade with the first thing wrong with its shape, or null."""
    return moves.groupBy("trade_id").agg(
        F.count("*").alias("n_moves"),
        F.min(F.least("from_team", "to_team")).alias("lo"),
        F.max(F.greatest("from_team", "to_team")).alias("hi"),
        F.count_if(F.col("from_team") == F.col("to_team")).alias("n_self"),
        F.count_distinct("player").alias("n_players"),
    ).select("trade_id", "n_moves", _shape_error(max_moves).alias("error"))


def with_trade_errors(moves: DataFrame, max_moves: int | None = None) -> DataFrame:
    """Every move with its trade's `error` as `trade_errors` states it; moves dealt out by trade don't move again."""
    trade = W.partitionBy("trade_id")
    counts = {
        "n_moves": F.count("*").over(trade),
        "lo": F.min(F.least("from_team", "to_team")).over(trade),
        "hi": F.max(F.greatest("from_team", "to_team")).over(trade),
        "n_self": F.count_if(F.col("from_team") == F.col("to_team")).over(trade),
        "n_players": F.size(F.collect_set("player").over(trade)),
    }
    rows = moves.where("trade_id is not null").withColumns(counts)
    return rows.withColumn("error", _shape_error(max_moves)).drop(*counts)


def moves_to_legs(moves: DataFrame) -> DataFrame:
    """Each move is one send and one receive."""
    ends = F.array(
        F.struct(F.col("from_team").alias("team"), F.lit("send").alias("direction")),
        F.struct(F.col("to_team").alias("team"), F.lit("receive").alias("direction")),
    )
    keep = [c for c in moves.columns if c not in ("from_team", "to_team")]
    return moves.select(*keep, F.explode(ends).alias("e")).select(*keep, "e.team", "e.direction")


def kicked(amount: Column, state: Column, pct: Column) -> Column:
    """A received figure with its kicker; an unknown kicker adds nothing."""
    share = F.when(state == "known", pct).otherwise(F.lit(0.0))
    return R.trunc(amount.cast("double") * (F.lit(1.0) + share))


def leg_totals(moves: DataFrame, *more: Column) -> DataFrame:
    """Sums per (trade, team), and `more` aggregates over the same rows."""
    send = F.col("direction") == "send"
    receive = ~send

    def total(c: Column, cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, c)), F.lit(0)).cast("bigint")

    amount = F.col("amount")
    return (
        moves_to_legs(moves)
        .groupBy("trade_id", "team", "season", "trade_date")
        .agg(
            total(amount, send).alias("outgoing"),
            total(kicked(amount, F.col("kicker_state"), F.col("pct")), receive).alias("incoming"),
            total(amount, receive).alias("incoming_base"),
            F.count_if(send).alias("n_sends"),
            F.count_if(receive).alias("n_receives"),
            F.count_if(receive & (F.col("kicker_state") == "unknown")).alias("n_unknown_kickers"),
            *more,
        )
    )


def leg_states(legs: DataFrame, positions: DataFrame, base_cap: int) -> DataFrame:
    """Legs with everything a rule needs to know about the team, on one row.

    `positions` has a row for every known team and season, of zeros for one without contracts; a leg
    of any other team or season fails the job, as nothing can be said of it.
    """
    room = F.col("salary_cap") - F.col("cap_salary")
    who = F.concat(F.lit("no team "), F.col("team").cast("string"), F.lit(" in season "), F.col("season").cast("string"))
    known = F.when(F.col("apron_salary").isNull(), F.raise_error(who).cast("bigint")).otherwise(F.col("apron_salary"))
    return (
        legs.join(positions.drop("committed", "dead", "holds", "restricted"), ["team", "season"], "left")
        .withColumn("base_cap", R.big(base_cap))
        .withColumn("post_salary", known - F.col("outgoing") + F.col("incoming"))
        .withColumn("cushion", R.cushion(F.col("post_salary"), F.col("first_apron")))
        .withColumn("cap_room", F.when(room > 0, room))
    )


# -- rules over legs -------------------------------------------------------


def barred_flags(legs: DataFrame, rules: R.RuleSet = R.RuleSet()) -> DataFrame:
    """Which exceptions a leg may not use because of where it would end."""
    levels = {row: level for row, level, _ in K.RESTRICTION_ROWS}
    for kind, row in K.TRIGGERED_ROW.items():
        level = F.col("first_apron") if levels[row] == "first_apron" else F.col("second_apron")
        legs = legs.withColumn(
            f"bar_{kind}",
            ~R.may_engage(F.lit(row), F.col("post_salary"), level, F.col("season_id"), rules),
        )
    return legs


def check_matching(
    legs: DataFrame, sends: DataFrame, rules: R.RuleSet = R.RuleSet()
) -> DataFrame:
    """Legs taking back more than they send, with the exception used or the code of the failure.

    One exception is tried first. Only legs it does not cover, sending two or more players,
    go on to the split over several exceptions.
    """
    from factline.operators import structures

    keys = ["trade_id", "team"]
    need = barred_flags(legs.where("incoming > outgoing"), rules)
    barred = {k: F.col(f"bar_{k}") for k in K.TRIGGERED_ROW}

    def best(exclude):
        return R.best_allowance(
            F.col("outgoing"), F.col("incoming"), F.col("cushion"), F.col("season_id"),
            F.col("salary_cap"), F.col("base_cap"), F.col("n_sends") >= 2, F.col("cap_room"),
            exclude, rules,
        )

    tried = need.withColumn("one", best(barred)).withColumn("one_free", best({}))
    open_legs = tried.where("one is null and n_sends > 1")
    split = structures.best_structures(
        sends.select(*keys, "contract_id", "amount"),
        open_legs.select(*keys, "cushion", "salary_cap", "base_cap", "bar_expanded", "bar_aggregated"),
        keys,
        ["contract_id"],
        {"split": ("bar_expanded", "bar_aggregated"), "free": (None, None)},
    ).select(*keys, "split_total", "split_groups", "free_total")
    fits = F.coalesce(F.col("incoming") <= F.col("split_total"), F.lit(False))
    fits_free = F.coalesce(F.col("incoming") <= F.col("free_total"), F.lit(False))
    any_bar = R.any_of(*barred.values())
    return tried.join(split, keys, "left").select(
        "trade_id", "team", "outgoing", "incoming", "post_salary", "first_apron", "second_apron",
        F.when(F.col("one").isNotNull(), F.col("one.kind")).when(fits, "structure").alias("used"),
        F.when(F.col("one").isNull() & fits, F.col("split_groups")).alias("exceptions_used"),
        F.when(F.col("one").isNotNull() | fits, F.lit(None))
        .when(any_bar & (F.col("one_free").isNotNull() | fits_free), "apron_transaction_barred")
        .otherwise("no_exception_available")
        .alias("code"),
    )


def triggered_notes(matched: DataFrame) -> DataFrame:
    """Legs whose exception hard-caps the team, with the row and the ceiling it sets."""
    levels = {row: level for row, level, _ in K.RESTRICTION_ROWS}
    rows = F.create_map(*[F.lit(x) for kv in K.TRIGGERED_ROW.items() for x in kv])
    level = F.create_map(*[F.lit(x) for r, lv in levels.items() for x in (r, lv)])
    return (
        matched.where(F.col("used").isin(*K.TRIGGERED_ROW))
        .withColumn("row", F.element_at(rows, F.col("used")))
        .withColumn("ceiling", F.element_at(level, F.col("row")))
    )


def check_ceiling(legs: DataFrame) -> DataFrame:
    return legs.where("post_salary > ceiling_amount")


def check_roster(legs: DataFrame, rules: R.RuleSet = R.RuleSet()) -> DataFrame:
    after = F.col("standard_count") - F.col("n_sends") + F.col("n_receives")
    return legs.withColumn("after", after).where(F.col("after") > rules.standard_max)


def check_aggregation(sends: DataFrame, legs: DataFrame) -> DataFrame:
    """Players signed under sixty days before, in a leg that sends two or more."""
    recent = F.datediff("trade_date", "signed_date") < K.AGGREGATION_BAR_DAYS
    return sends.where(recent).join(
        legs.where("n_sends >= 2").select("trade_id", "team"), ["trade_id", "team"], "left_semi"
    )


def active_restrictions(on: str):
    """Join condition part: the restriction has no end or has not ended by that date."""
    return F.col("expires").isNull() | (F.col(on) <= F.col("expires"))


def check_restricted(sends: DataFrame, restrictions: DataFrame) -> DataFrame:
    r = restrictions.where("blocks_trade").withColumnRenamed("player", "r_player")
    return sends.join(
        r, (sends["player"] == r["r_player"]) & active_restrictions("trade_date"), "left_semi"
    )


def violations(
    legs: DataFrame, sends: DataFrame, restrictions: DataFrame, rules: R.RuleSet = R.RuleSet()
) -> DataFrame:
    """Every violation as (trade_id, team, code, subject)."""

    def rows(df: DataFrame, code, subject=None) -> DataFrame:
        subject = F.lit(None).cast("bigint") if subject is None else F.col(subject)
        return df.select("trade_id", "team", code.alias("code"), subject.alias("subject"))

    return (
        rows(check_matching(legs, sends, rules).where("code is not null"), F.col("code"))
        .unionByName(rows(check_ceiling(legs), F.lit("hard_cap_ceiling_exceeded")))
        .unionByName(rows(check_roster(legs, rules), F.lit("roster_maximum_exceeded")))
        .unionByName(rows(check_aggregation(sends, legs), F.lit("aggregation_two_month_bar"), "player"))
        .unionByName(
            rows(check_restricted(sends, restrictions), F.lit("player_trade_restricted"), "player")
        )
    )


def verdicts(legs: DataFrame, found: DataFrame) -> DataFrame:
    """Legal when nothing is violated, conditional when anything was assumed."""
    per_trade = found.groupBy("trade_id").agg(
        F.count("*").alias("n_violations"),
        F.array_join(F.array_sort(F.collect_set("code")), "|").alias("codes"),
    )
    assumed = legs.groupBy("trade_id").agg(
        F.sum("n_unknown_kickers").cast("bigint").alias("n_assumptions")
    )
    n = F.coalesce("n_violations", F.lit(0))
    return assumed.join(per_trade, "trade_id", "left").select(
        "trade_id",
        (n == 0).alias("legal"),
        (F.col("n_assumptions") > 0).alias("conditional"),
        n.alias("n_violations"),
        "n_assumptions",
        "codes",
    )


def citation_rows(spark) -> DataFrame:
    """Seven rows: what each violation code cites."""
    return spark.createDataFrame(
        [(code, *c) for code, c in K.CITATIONS.items()],
        "code string, article string, section string, page bigint, title string",
    )


def with_citation(found: DataFrame) -> DataFrame:
    return found.join(F.broadcast(citation_rows(found.sparkSession)), "code", "left")


def trade_sides(legs: DataFrame) -> DataFrame:
    """Each side before and after, measured again on the new totals."""
    delta = F.col("incoming_base") - F.col("outgoing")
    return legs.select(
        "trade_id", "team",
        F.col("cap_salary").alias("before_cap"),
        F.col("apron_salary").alias("before_apron"),
        F.col("status").alias("before_status"),
        (F.col("cap_salary") + delta).alias("after_cap"),
        (F.col("apron_salary") + delta).alias("after_apron"),
        R.apron_status(
            F.col("cap_salary") + delta, F.col("apron_salary") + delta, F.col("salary_cap"),
            F.col("tax_level"), F.col("first_apron"), F.col("second_apron"),
        ).alias("after_status"),
        (F.col("standard_count") - F.col("n_sends") + F.col("n_receives")).alias("after_contracts"),
    )
