"""Folds over the elements of an array that give something back for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Appending to an array copies it, so what a fold gives back is gathered in parts of so many elements.
PART = 128


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often `body` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(items: Column, start: Column, step: Callable[[Column, Column], Column], out: str) -> Column:
    """What `step(state, item)`, a struct (state, out), gives out for each item in order, as an array of type `out`.

    The work grows with the number of items and hardly with its square: parts are short, and the
    list of parts is a small share of the items.
    """
    empty, none = F.array().cast(f"array<{out}>"), F.array().cast(f"array<array<{out}>>")

    def one(acc: Column, item: Column) -> Column:
        return bind(
            step(acc["state"], item),
            lambda r: F.struct(r["state"].alias("state"), F.concat(acc["outs"], F.array(r["out"].cast(out))).alias("outs")),
        )

    def part(acc: Column, some: Column) -> Column:
        return bind(
            F.aggregate(some, F.struct(acc["state"].alias("state"), empty.alias("outs")), one),
            lambda r: F.struct(r["state"].alias("state"), F.concat(acc["parts"], F.array(r["outs"])).alias("parts")),
        )

    def over(own: Column) -> Column:
        parts = F.transform(
            F.sequence(F.lit(0), ((F.size(own) - 1) / PART).cast("int")), lambda i: F.slice(own, i * PART + 1, F.lit(PART))
        )
        return F.flatten(F.aggregate(parts, F.struct(start.alias("state"), none.alias("parts")), part)["parts"])

    return bind(items, over)
