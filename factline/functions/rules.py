"""Scalar rules as Column expressions. Money is bigint; doubles truncate toward zero."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from factline.functions import constants as K


@dataclass(frozen=True)
class RuleSet:
    """What changes from one agreement to the next."""

    transition_season: str = "2023-2024"
    base_season: str = "2023-2024"
    allowance: int = K.ALLOWANCE
    standard_max: int = K.STANDARD_MAX
    standard_min: int = K.STANDARD_MIN


def big(value: int) -> Column:
    return F.lit(value).cast("bigint")


def trunc(c: Column) -> Column:
    """A double as a whole number, the fraction dropped."""
    return c.cast("bigint")


def floor_div(a: Column, b: Column) -> Column:
    """Whole-number division rounding down, exact for large figures."""
    return F.call_function("div", (a - F.pmod(a, b)).cast("bigint"), b)


def season_start(d: Column) -> Column:
    """The fiscal year a date belongs to; it starts in July."""
    return F.year(F.add_months(d, -6)).cast("bigint")


def season_id_of(year: Column) -> Column:
    return F.concat(year.cast("string"), F.lit("-"), (year + 1).cast("string"))


def season_id(d: Column) -> Column:
    return season_id_of(season_start(d))


# -- salary matching -----------------------------------------------------


def cushion(post: Column, first_apron: Column, rules: RuleSet = RuleSet()) -> Column:
    return F.when(post > first_apron, big(0)).otherwise(big(rules.allowance))


def allow_standard(outgoing: Column, cush: Column) -> Column:
    return outgoing + cush


def allow_transition(
    outgoing: Column, cush: Column, season: Column, rules: RuleSet = RuleSet()
) -> Column:
    """Null outside its one season."""
    return F.when(
        season == rules.transition_season,
        trunc(outgoing.cast("double") * K.TRANSITION_FACTOR) + cush,
    )


def allow_expanded(outgoing: Column, cush: Column, cap: Column, base_cap: Column) -> Column:
    doubled = trunc(outgoing.cast("double") * K.EXPANDED_DOUBLE) + cush
    scaled = outgoing + trunc(cap.cast("double") * K.EXPANDED_BASE_AMOUNT / base_cap.cast("double"))
    floor = trunc(outgoing.cast("double") * K.EXPANDED_FACTOR) + cush
    return F.greatest(F.least(doubled, scaled), floor)


def allow_room(cap_room: Column, cush: Column) -> Column:
    """Null when the team has no room."""
    return F.when(cap_room > 0, cap_room + cush)


def best_allowance(
    outgoing: Column,
    incoming: Column,
    cush: Column,
    season: Column,
    cap: Column,
    base_cap: Column,
    aggregating: Column,
    cap_room: Column,
    barred: dict[str, Column] | None = None,
    rules: RuleSet = RuleSet(),
) -> Column:
    """The first exception, least consequential first, that permits the incoming salary.

    Null when none does. `barred` maps an exception to a flag that takes it out.
    """
    barred = barred or {}
    offers = [
        ("room", allow_room(cap_room, cush)),
        ("standard", F.when(~aggregating, allow_standard(outgoing, cush))),
        ("aggregated", F.when(aggregating, allow_standard(outgoing, cush))),
        ("transition", allow_transition(outgoing, cush, season, rules)),
        ("expanded", allow_expanded(outgoing, cush, cap, base_cap)),
    ]
    picked = []
    for kind, amount in offers:
        fits = amount.isNotNull() & (incoming <= amount)
        if kind in barred:
            fits = fits & ~barred[kind]
        picked.append(
            F.when(fits, F.struct(F.lit(kind).alias("kind"), amount.alias("amount")))
        )
    return F.coalesce(*picked)


# -- restriction rows ----------------------------------------------------


def may_engage(
    row: Column, after: Column, level: Column, season: Column, rules: RuleSet = RuleSet()
) -> Column:
    exempt = (season == rules.transition_season) & row.between("F", "J")
    return exempt | (after <= level)


def restriction_rows(
    salary: Column,
    first_apron: Column,
    second_apron: Column,
    season: Column,
    rules: RuleSet = RuleSet(),
    reachable_only: bool = False,
) -> Column:
    """The restriction table against one salary, as an array of structs."""
    out = []
    for row, level, phrase in K.RESTRICTION_ROWS:
        if reachable_only and row == "G":
            continue
        amount = first_apron if level == "first_apron" else second_apron
        out.append(
            F.struct(
                F.lit(row).alias("row"),
                F.lit(level).alias("level"),
                amount.alias("level_amount"),
                may_engage(F.lit(row), salary, amount, season, rules).alias("permitted"),
                F.lit(phrase).alias("phrase"),
            )
        )
    return F.array(*out)


def binds_next_year(row: Column) -> Column:
    return row.between("E", "J")


def requires_near_cap(team_salary: Column, exception_amount: Column, cap: Column) -> Column:
    return (team_salary >= cap) | ((cap - team_salary) < exception_amount)


# -- position ------------------------------------------------------------


def apron_status(
    cap_salary: Column, apron: Column, cap: Column, tax: Column, first: Column, second: Column
) -> Column:
    """Room is asked of cap salary, the other bands of apron salary."""
    return (
        F.when(cap_salary < cap, "room")
        .when(apron < tax, "over_cap")
        .when(apron < first, "taxpayer")
        .when(apron < second, "first_apron")
        .otherwise("second_apron")
    )


def hold_kind(label: Column) -> Column:
    return (
        F.when(label.startswith("Restricted"), "qualifying_offer")
        .when(label.isin("1st Round Pick", "Draft Pick"), "draft_pick")
        .when(label == "Two-Way", "two_way")
        .otherwise("free_agent")
    )


def bird_rights(label: Column) -> Column:
    pairs = [F.lit(x) for kv in K.BIRD_RIGHTS.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), label), F.lit("None"))


def roster_flags(standard: Column, two_way: Column, rules: RuleSet = RuleSet()) -> list[Column]:
    return [
        (standard > rules.standard_max).alias("over_standard_max"),
        (standard < rules.standard_min).alias("below_standard_min"),
        (two_way > K.TWO_WAY_MAX).alias("over_two_way_max"),
        F.greatest(big(0), big(rules.standard_max) - standard).alias("open_standard_slots"),
    ]


# -- salaries ------------------------------------------------------------


def max_salary(
    yos: Column,
    cap: Column,
    prior: Column,
    meets_criteria: Column,
    fifth_year: Column,
    veteran_tenure: Column,
) -> Column:
    """Struct of amount, percentage, tier, used_prior_floor, higher_max."""
    fifth = (yos < 7) & meets_criteria & fifth_year
    veteran = yos.between(8, 9) & meets_criteria & veteran_tenure
    pct = (
        F.when(fifth, F.lit(K.HIGHER_FIFTH_YEAR))
        .when(veteran, F.lit(K.HIGHER_DESIGNATED_VETERAN))
        .when(yos < 7, F.lit(K.MAX_UNDER_7))
        .when(yos < 10, F.lit(K.MAX_7_TO_9))
        .otherwise(F.lit(K.MAX_10_PLUS))
    )
    by_pct = trunc(pct * cap.cast("double"))
    floor = F.coalesce(trunc(prior.cast("double") * K.PRIOR_SALARY_MULTIPLIER), big(0))
    return F.struct(
        F.greatest(by_pct, floor).alias("amount"),
        pct.alias("percentage"),
        F.when(yos < 7, "under_seven")
        .when(yos < 10, "seven_to_nine")
        .otherwise("ten_plus")
        .alias("tier"),
        (floor > by_pct).alias("used_prior_floor"),
        (fifth | veteran).alias("higher_max"),
    )


def deemed_salary(final_year: Column, total: Column, years: Column, applies: Column) -> Column:
    """Floor average over all years where the rule applies, else the actual figure."""
    return F.when(applies, floor_div(total, years)).otherwise(final_year)


def arenas_applies(yos: Column) -> Column:
    return yos.isin(1, 2)


def arenas_fourth_year(third: Column) -> list[Column]:
    delta = trunc(third.cast("double") * K.ARENAS_FOURTH_YEAR_MOVEMENT)
    return [(third - delta).alias("fourth_low"), (third + delta).alias("fourth_high")]


def minimum_year(yos: Column, top: Column) -> Column:
    return F.least(yos, top)


def guaranteed_amount(kind: Column, cap_figure: Column, amount: Column) -> Column:
    """Null for an unknown kind; use `guaranteed_amount_strict` to fail instead."""
    return (
        F.when(kind == "full", cap_figure)
        .when(kind == "none", big(0))
        .when(kind == "partial", F.coalesce(amount, big(0)))
    )


def guaranteed_amount_strict(kind: Column, cap_figure: Column, amount: Column) -> Column:
    return F.when(
        kind == "unknown", F.raise_error(F.lit("guarantee structure is unknown")).cast("bigint")
    ).otherwise(guaranteed_amount(kind, cap_figure, amount))


# -- dates ---------------------------------------------------------------


def january_gate(signed: Column) -> Column:
    """January 15 of the fiscal year of signing."""
    return F.make_date(F.year(F.add_months(signed, -6)) + 1, F.lit(1), F.lit(15))


def december_gate(signed: Column) -> Column:
    """December 15 of the calendar year of signing."""
    return F.make_date(F.year(signed), F.lit(12), F.lit(15))


def free_agent_from(signed: Column) -> Column:
    return F.greatest(F.add_months(signed, K.BAR_MONTHS), december_gate(signed))


def re_signed_from(signed: Column) -> Column:
    return F.greatest(F.add_months(signed, K.BAR_MONTHS), january_gate(signed))


def rookie_from(signed: Column) -> Column:
    return F.date_add(signed, K.ROOKIE_DAYS)


def trade_eligibility(
    when: Column,
    signed: Column,
    re_signed: Column,
    free_agent: Column,
    rookie: Column,
    sign_and_trade: Column,
) -> Column:
    """Struct of tradeable, reason, eligible_from; the first bar in force wins."""

    def barred(reason: str, until: Column) -> Column:
        return F.struct(
            F.lit(False).alias("tradeable"),
            F.lit(reason).alias("reason"),
            until.alias("eligible_from"),
        )

    return (
        F.when(
            re_signed & (when < re_signed_from(signed)),
            barred("re_signed_with_raise", re_signed_from(signed)),
        )
        .when(
            free_agent & ~sign_and_trade & (when < free_agent_from(signed)),
            barred("free_agent_signing", free_agent_from(signed)),
        )
        .when(
            rookie & (when < rookie_from(signed)),
            barred("rookie_or_two_way_30_days", rookie_from(signed)),
        )
        .otherwise(
            F.struct(
                F.lit(True).alias("tradeable"),
                F.lit(None).cast("string").alias("reason"),
                F.lit(None).cast("date").alias("eligible_from"),
            )
        )
    )


def re_signed_applies(
    over_cap: Column, veteran: Column, new_first: Column, prior_last: Column, minimum: Column
) -> Column:
    raised = new_first.cast("double") > prior_last.cast("double") * K.RE_SIGNED_RAISE
    return ~minimum & over_cap & veteran & raised


def deadline_for(game: Column) -> Column:
    """The second Thursday before the game; a Thursday game goes a full week back."""
    return F.date_sub(F.next_day(F.date_sub(game, 8), "THU"), 7)


def trading_window(
    when: Column, game: Column, last_game: Column, moratorium: Column, postseason: Column
) -> Column:
    """Struct of open and the reason it is closed."""

    def closed(why: str) -> Column:
        return F.struct(F.lit(False).alias("open"), F.lit(why).alias("reason"))

    return (
        F.when(moratorium, closed("moratorium"))
        .when((when > deadline_for(game)) & (when <= last_game), closed("deadline_passed"))
        .when((when > last_game) & postseason, closed("postseason_roster"))
        .otherwise(
            F.struct(F.lit(True).alias("open"), F.lit(None).cast("string").alias("reason"))
        )
    )


def age_on(birth: Column, when: Column) -> Column:
    had = (F.month(when) > F.month(birth)) | (
        (F.month(when) == F.month(birth)) & (F.dayofmonth(when) >= F.dayofmonth(birth))
    )
    return (F.year(when) - F.year(birth) - F.when(had, 0).otherwise(1)).cast("bigint")


def over_38(n_seasons: Column, last_season: Column, birth_year: Column) -> Column:
    """Four or more seasons, one of them starting at 38 or later."""
    return (n_seasons >= 4) & (last_season - birth_year >= 38)


# -- exceptions and picks ------------------------------------------------


def exception_remaining(amount: Column, used: Column) -> Column:
    return F.greatest(big(0), amount - used)


def exception_live(expires: Column, remaining: Column, on: Column) -> Column:
    return (on <= expires) & (remaining > 0)


def exception_usable(
    live: Column, status: Column, created: Column, season_year: Column
) -> Column:
    return live & ~((status == "second_apron") & (F.year(created) < season_year))


def exception_expired(expires: Column, on: Column) -> Column:
    """Null when either date is unknown."""
    return F.when(expires.isNotNull() & on.isNotNull(), expires < on)


# -- money text ----------------------------------------------------------


def fmt_dollars(c: Column) -> Column:
    sign = F.when(c < 0, "−").otherwise("")
    return F.concat(sign, F.lit("$"), F.format_number(F.abs(c), 0))


def fmt_millions(c: Column) -> Column:
    """One decimal, exact ties away from zero."""
    size = F.abs(c)
    nudged = size + F.when(size % 1_000_000 == 250_000, 1).otherwise(0)
    text = F.translate(F.format_number(nudged.cast("double") / 1_000_000, 1), ",", "")
    return F.concat(F.when(c < 0, "−").otherwise(""), F.lit("$"), text, F.lit("M"))


def describe_over(over: Column) -> Column:
    """`over` is the salary minus the level."""
    return (
        F.when(over < 0, F.concat(fmt_millions(-over), F.lit(" under")))
        .when(over > 0, F.concat(fmt_millions(over), F.lit(" over")))
        .otherwise(F.lit("exactly at"))
    )


def any_of(*flags: Column) -> Column:
    return reduce(lambda a, b: a | b, flags)
