"""Where each team stands: totals, bands, ceilings, and the sheet behind them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factline.functions import rules as R


def counted(ledger: DataFrame) -> DataFrame:
    """Ledger lines with the amount each counts for in the cap and the apron total."""
    offer = F.when(F.col("offer") > 0, F.col("offer")).otherwise(F.col("amount"))
    apron = F.when(F.col("kind") != "hold", F.col("amount")).otherwise(
        F.when(R.hold_kind(F.col("label")) == "qualifying_offer", offer).otherwise(0)
    )
    return ledger.withColumn("cap", F.col("amount")).withColumn("apron", apron.cast("bigint"))


def team_totals(ledger: DataFrame) -> DataFrame:
    """One row per (team, season). A hold without a season counts in every season.

    One shuffle over the ledger with partial sums; what is left is (teams x seasons) rows.
    """

    def total(value: str, cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col(value))), F.lit(0)).cast("bigint")

    hold = F.col("kind") == "hold"
    contract = F.col("kind") == "contract"
    sums = (
        counted(ledger)
        .groupBy("team", "season")
        .agg(
            total("amount", contract).alias("committed"),
            F.count_if(contract & (F.col("amount") > 0)).alias("standard_count"),
            total("amount", F.col("kind") == "dead").alias("dead"),
            total("amount", hold).alias("holds"),
            total("apron", hold).alias("restricted"),
        )
    )
    every = W.partitionBy("team")
    undated = F.col("season").isNull()
    return (
        sums.select(
            "*",
            F.sum(F.when(undated, F.col("holds")).otherwise(0)).over(every).alias("every_hold"),
            F.sum(F.when(undated, F.col("restricted")).otherwise(0)).over(every).alias("every_restricted"),
        )
        .where(~undated)
        .withColumn("holds", F.col("holds") + F.col("every_hold"))
        .withColumn("restricted", F.col("restricted") + F.col("every_restricted"))
        .withColumn("cap_salary", F.col("committed") + F.col("dead") + F.col("holds"))
        .withColumn("apron_salary", F.col("committed") + F.col("dead") + F.col("restricted"))
        .drop("every_hold", "every_restricted")
    )


def with_known_teams(ledger: DataFrame, teams: DataFrame, first: int, last: int) -> DataFrame:
    """The ledger with an empty line for every team and season from `first` to `last`, so that a known team
    without contracts has a position of zero."""
    every = F.sequence(R.big(first), R.big(last))
    blank = teams.select("team").distinct().select("team", F.explode(every).alias("season"))
    blank = blank.withColumn("kind", F.lit("none")).withColumn("amount", R.big(0))
    return ledger.select("team", "season", "kind", "amount", "label", "offer").unionByName(blank, allowMissingColumns=True)


def trigger_text(category: Column, detail: Column) -> Column:
    """`category — detail`, leaving out what is empty."""
    return F.concat_ws(" — ", F.nullif(category, F.lit("")), F.nullif(detail, F.lit("")))


def binding_ceilings(ceilings: DataFrame) -> DataFrame:
    """The binding level per team and season (first apron is always the lower) and every trigger."""
    return ceilings.groupBy("team", "season").agg(
        F.min("level").alias("ceiling_level"),
        F.array_join(
            F.array_sort(F.collect_set(trigger_text(F.col("category"), F.col("detail")))), " | "
        ).alias("triggers"),
    )


def with_thresholds(totals: DataFrame, seasons: DataFrame) -> DataFrame:
    return totals.join(F.broadcast(seasons), "season")


def status_column() -> Column:
    return R.apron_status(
        F.col("cap_salary"), F.col("apron_salary"), F.col("salary_cap"),
        F.col("tax_level"), F.col("first_apron"), F.col("second_apron"),
    )


def ceiling_amount(level: Column) -> Column:
    return F.when(level == "first_apron", F.col("first_apron")).when(
        level == "second_apron", F.col("second_apron")
    )


def team_state(ledger: DataFrame, seasons: DataFrame, ceilings: DataFrame) -> DataFrame:
    """Totals, status, roster count and binding ceiling, one row per (team, season)."""
    return (
        with_thresholds(team_totals(ledger), seasons)
        .withColumn("status", status_column())
        .join(binding_ceilings(ceilings), ["team", "season"], "left")
        .withColumn("ceiling_amount", ceiling_amount(F.col("ceiling_level")))
        .select(
            "team", "season", "season_id", "committed", "dead", "holds", "restricted",
            "cap_salary", "apron_salary", "standard_count", "salary_cap", "tax_level",
            "first_apron", "second_apron", "status", "ceiling_level", "ceiling_amount", "triggers",
        )
    )


# -- tri-state values ------------------------------------------------------


def maybe(state: Column, value: Column) -> Column:
    """known(value), absent or unknown; a known without a value is unknown."""
    known = (state == "known") & value.isNotNull()
    kind = F.when(known, "known").when(state == "absent", "absent").otherwise("unknown")
    return F.struct(kind.alias("state"), F.when(known, value).alias("value"))


def require(m: Column, what: str) -> Column:
    """The value, or a failed job."""
    return F.when(m["state"] == "known", m["value"]).otherwise(
        F.raise_error(F.concat(F.lit(f"{what} is "), m["state"]))
    )


def or_absent(m: Column) -> Column:
    """The value or null for absent; an unknown fails."""
    return F.when(m["state"] == "known", m["value"]).when(
        m["state"] == "unknown", F.raise_error(F.lit("value is unknown"))
    )


def assume(m: Column, default: Column, field: str, subject: Column, reason: str) -> Column:
    """Struct of the value to use and, only when it was unknown, the assumption made."""
    unknown = m["state"] == "unknown"
    note = F.struct(
        F.lit(field).alias("field"),
        subject.cast("string").alias("subject"),
        default.cast("string").alias("assumed"),
        F.lit(reason).alias("reason"),
    )
    return F.struct(
        F.when(m["state"] == "known", m["value"]).otherwise(default).alias("value"),
        F.when(unknown, F.array(note)).otherwise(F.array().cast(
            "array<struct<field:string,subject:string,assumed:string,reason:string>>"
        )).alias("assumptions"),
    )


# -- contracts and the sheet -----------------------------------------------


def assemble_contracts(years: DataFrame) -> DataFrame:
    """Child rows as one ordered array per contract; a contract has a handful of years."""
    return years.groupBy("contract_id", "team", "player").agg(
        F.array_sort(
            F.collect_list(F.struct("season", "cap_figure", "guarantee_kind", "option_kind"))
        ).alias("years")
    )


def holds_for(holds: DataFrame, season: int) -> DataFrame:
    """Holds of a season, with those that name none; an offer of zero is no offer."""
    return holds.where((F.col("season") == season) | F.col("season").isNull()).withColumn(
        "offer", F.nullif(F.col("offer"), R.big(0))
    )


KIND_ORDER = {"contract": 0, "dead": 1, "hold": 2}


def cap_sheet_lines(ledger: DataFrame) -> DataFrame:
    """Every line with what it counts for; `kind_rank`, then amount, is the reading order."""
    kinds = [F.lit(x) for kv in KIND_ORDER.items() for x in kv]
    return counted(ledger).withColumn(
        "kind_rank", F.element_at(F.create_map(*kinds), F.col("kind"))
    )


def strict_thresholds(seasons: DataFrame) -> DataFrame:
    """Fails on a missing threshold: a figure that is compared against cannot be guessed."""
    money = [c for c in seasons.columns if c not in ("season", "season_id")]
    gap = F.greatest(*[F.col(c).isNull().cast("int") for c in money]) == 1
    checked = F.when(
        gap, F.raise_error(F.concat(F.lit("season is missing a threshold: "), F.col("season_id")))
    ).otherwise(F.col("season_id"))
    return seasons.withColumn("season_id", checked)


def threshold_errors(seasons: DataFrame) -> DataFrame:
    money = [c for c in seasons.columns if c not in ("season", "season_id")]
    missing = F.filter(
        F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in money]), lambda x: x.isNotNull()
    )
    return seasons.withColumn("missing", F.array_join(missing, ",")).where("missing <> ''")


def second_or_first(second: Column, first: Column) -> Column:
    """A second apron of zero was not set yet; the first stands in."""
    return F.coalesce(F.nullif(second, R.big(0)), first)


def later_totals(years: DataFrame, n: int = 4) -> DataFrame:
    """Totals of the next n distinct seasons after each (team, season) with contracts.

    years: team, season, cap_figure, first_season. One aggregate; the window that follows
    runs over (teams x seasons) rows only.
    """
    sums = years.groupBy("team", F.col("first_season").alias("season"), F.col("season").alias("later")).agg(
        F.sum("cap_figure").cast("bigint").alias("total")
    )
    w = W.partitionBy("team", "season").orderBy("later")
    return (
        sums.where("later > season")
        .withColumn("column", F.dense_rank().over(w))
        .where(F.col("column") <= n)
    )


def threshold_marks() -> Column:
    """Each level with the total it is measured against, as an array of structs."""

    def mark(name: Column, level: Column, against: str, total: Column) -> Column:
        return F.struct(
            name.alias("mark"),
            level.alias("amount"),
            F.lit(against).alias("against"),
            (total - level).alias("over"),
        )

    apron = F.col("apron_salary")
    return F.array_compact(
        F.array(
            mark(F.lit("salary_cap"), F.col("salary_cap"), "cap", F.col("cap_salary")),
            mark(F.lit("tax_level"), F.col("tax_level"), "apron", apron),
            mark(F.lit("first_apron"), F.col("first_apron"), "apron", apron),
            mark(F.lit("second_apron"), F.col("second_apron"), "apron", apron),
            F.when(
                F.col("ceiling_amount").isNotNull(),
                mark(F.lit("ceiling"), F.col("ceiling_amount"), "apron", apron),
            ),
        )
    )


def cap_sheet(
    positions: DataFrame, lines: DataFrame, exceptions: DataFrame, later: DataFrame
) -> DataFrame:
    """The sheet's summary row: totals, ceiling room, line counts, later totals, warnings."""
    by_line = lines.groupBy("team", "season").agg(
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KIND_ORDER],
        F.count_if((F.col("kind") == "hold") & F.col("player").isNull()).alias("n_unnamed"),
    )
    held = exceptions.groupBy("team").agg(F.count("*").alias("n_exceptions"))
    next_years = later.groupBy("team", "season").agg(
        F.sum("total").cast("bigint").alias("later_total"), F.count("*").alias("n_later")
    )
    n = F.coalesce("n_exceptions", F.lit(0))
    warnings = F.filter(
        F.array(
            F.lit("unknown_terms"),
            F.when(F.col("n_unnamed") > 0, "unnamed_holds"),
            F.when(n > 0, "older_exceptions"),
        ),
        lambda x: x.isNotNull(),
    )
    return (
        positions.join(by_line, ["team", "season"], "left")
        .join(held, "team", "left")
        .join(next_years, ["team", "season"], "left")
        .withColumn("n_exceptions", n)
        .withColumn("ceiling_room", F.col("ceiling_amount") - F.col("apron_salary"))
        .withColumn("warnings", F.array_join(warnings, "|"))
    )


def headroom(positions: DataFrame) -> DataFrame:
    """Room and the distance to every level, for a ranking of the whole league."""
    return positions.select(
        "team",
        "season",
        "status",
        (F.col("salary_cap") - F.col("cap_salary")).alias("room"),
        (F.col("tax_level") - F.col("apron_salary")).alias("to_tax"),
        (F.col("first_apron") - F.col("apron_salary")).alias("to_first"),
        (F.col("second_apron") - F.col("apron_salary")).alias("to_second"),
    )


def current_teams(keys: DataFrame, contracts: DataFrame, season: int) -> DataFrame:
    """The team holding each asked player that season; null when on no payroll."""
    held = (
        contracts.where((F.col("season") == season) & (F.col("cap_figure") > 0))
        .groupBy("player")
        .agg(F.min_by("team", "contract_id").alias("team"))
    )
    return keys.join(held, "player", "left")


def with_names(df: DataFrame, players: DataFrame) -> DataFrame:
    return df.join(players.select("player", "display_name"), "player", "left")
