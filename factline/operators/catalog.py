"""The queryable surface: fixed views with typed, described fields."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TYPES = {"text": "string", "integer": "bigint", "real": "double", "date": "date"}
NUMERIC = ("integer", "real")


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    expr: Column
    description: str = ""


Rows = Callable[[], DataFrame]


@dataclass(frozen=True)
class Entity:
    """A view with its joins already written. Unused columns are pruned by the optimizer.

    `source` and `as_of` say where each row's provenance is, in the table the figures
    come from; a view without row dates falls back to when its source was read.
    """

    name: str
    build: Rows
    fields: tuple[Field, ...]
    description: str = ""
    source: Column | None = None
    as_of: Column | None = None

    @cached_property
    def frame(self) -> DataFrame:
        """The view itself, planned only when a query names it."""
        return self.build()

    def field(self, name: str) -> Field | None:
        return next((f for f in self.fields if f.name == name), None)

    @property
    def field_names(self) -> list[str]:
        return [f.name for f in self.fields]

    def select_all(self) -> DataFrame:
        return self.frame.select(*[f.expr.alias(f.name) for f in self.fields])


@dataclass(frozen=True)
class Catalog:
    entities: dict[str, Entity] = field(default_factory=dict)

    @classmethod
    def of(cls, *entities: Entity) -> Catalog:
        return cls({e.name: e for e in entities})

    def describe(self, spark: SparkSession) -> DataFrame:
        rows = [
            (e.name, f.name, f.type, f.description)
            for e in self.entities.values()
            for f in e.fields
        ]
        return spark.createDataFrame(
            rows, "entity string, field string, type string, description string"
        )


def text(name: str, expr: str | None = None, description: str = "") -> Field:
    return Field(name, "text", F.col(expr or name), description)


def integer(name: str, expr: str | None = None, description: str = "") -> Field:
    return Field(name, "integer", F.col(expr or name), description)


def date(name: str, expr: str | None = None, description: str = "") -> Field:
    return Field(name, "date", F.col(expr or name), description)


def contract_seasons(contracts: Rows, players: Rows) -> Entity:
    return Entity(
        "contract_seasons",
        lambda: contracts().join(players(), "player"),
        (
            text("player", "display_name", "Player name"),
            text("player_key", None, "Join key"),
            integer("team", None, "Team holding the contract"),
            text("season", "season_id", "Season, e.g. 1997-1998"),
            integer("salary", "cap_figure", "Cap figure for that season"),
            text("option_kind", None, "team or player; null if none"),
            text("guarantee_kind", None, "full, partial, none, or unknown, which is not full"),
            text("contract_type", None, "Contract classification"),
            date("signed_date", None, "When the contract was signed"),
            integer("years_of_service", None, "Seasons completed before this one"),
        ),
        "One row per player per contract season",
        F.col("source"),
        F.col("as_of"),
    )


def cap_holds(holds: Rows, players: Rows) -> Entity:
    from factline.functions import rules as R

    return Entity(
        "cap_holds",
        lambda: holds().join(players(), "player", "left"),
        (
            Field(
                "player",
                "text",
                F.coalesce("display_name", F.col("player").cast("string")),
                "Player name if resolved",
            ),
            integer("team", None, "Team"),
            integer("amount", None, "Hold amount against the cap"),
            text("bird_rights", "label", "Bird, Early Bird, Non-Bird, or other"),
            Field("kind", "text", R.hold_kind(F.col("label")), "Hold category"),
            Field(
                "qualifying_offer",
                "integer",
                F.nullif(F.col("offer"), R.big(0)),
                "Offer amount if any",
            ),
            integer("season", None, "Season the hold applies to"),
        ),
        "Cap holds by team, with rights classification",
        F.col("source"),
        F.col("as_of"),
    )


def hard_cap_ceilings(ceilings: Rows) -> Entity:
    return Entity(
        "hard_cap_ceilings",
        ceilings,
        (
            integer("team", None, "Team"),
            text("season", "season_id", "Season the ceiling binds in"),
            text("apron_level", "level", "first_apron or second_apron"),
            text("trigger_category", "category", "Kind of transaction that set it"),
            text("trigger_detail", "detail", "The specific transaction"),
        ),
        "Hard-cap ceilings a team's own transactions imposed on it; the lowest binds",
    )


def draft_picks(picks: Rows) -> Entity:
    return Entity(
        "draft_picks",
        picks,
        (
            integer("year", None, "Draft year"),
            integer("round", None, "First or second round"),
            integer("team", "owner", "Current owner"),
            integer("original_team", None, "Team the pick originated with"),
            Field("forfeited", "integer", F.col("forfeited").cast("bigint"), "1 if forfeited"),
            Field(
                "protection_text",
                "text",
                F.when(
                    F.col("protected_to") > 0,
                    F.concat(F.lit("protected 1-"), F.col("protected_to").cast("string")),
                ),
                "Protection prose, if any",
            ),
        ),
        "Draft pick ownership and protection",
    )


def trade_exceptions(exceptions: Rows) -> Entity:
    return Entity(
        "trade_exceptions",
        exceptions,
        (
            integer("team", None, "Holding team"),
            integer("amount", None, "Original amount"),
            Field("available", "integer", F.col("amount") - F.col("used"), "Remaining amount"),
            date("expires", None, "Expiry date"),
            text("kind", None, "Exception type; null if not stated"),
            text("reason", "contract_id", "Transaction that created it"),
        ),
        "Traded player exceptions, with original and remaining amounts",
        None,
        F.col("created"),
    )


def awards(rows: Rows, players: Rows) -> Entity:
    return Entity(
        "awards",
        lambda: rows().join(players(), "player", "left"),
        (
            Field(
                "player", "text", F.coalesce("display_name", F.col("player").cast("string")), "Name"
            ),
            integer("season", None, "Season"),
            text("award", None, "Award"),
            text("tier", None, "1st, 2nd or 3rd"),
        ),
        "Honours that raise a maximum",
    )


def seasons(rows: Rows) -> Entity:
    names = (
        "salary_cap", "tax_level", "first_apron", "second_apron", "non_taxpayer_mle", "taxpayer_mle",
    )
    return Entity(
        "seasons",
        rows,
        (text("season", "season_id", "Season"), *[integer(n) for n in names]),
        "League-wide thresholds per season",
    )
