"""Golden questions: each one a query and bounds on its answer."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factline.operators.catalog import Catalog
from factline.operators.query import Query, QueryError


@dataclass(frozen=True)
class Golden:
    """The answer is the first column of a one-row result, or what `value` makes of it.

    A golden without a query is a gap: a question the catalog cannot express.
    """

    name: str
    category: str
    query: Query | None = None
    value: Callable[[DataFrame], DataFrame] | None = None
    low: int | None = None
    high: int | None = None


def run_goldens(spark: SparkSession, catalog: Catalog, goldens: list[Golden]) -> DataFrame:
    """One row per golden: pass, fail, errored or gap. One lazy plan for all of them."""
    rows, fixed = [], []
    for g in goldens:
        if g.query is None:
            fixed.append((g.name, g.category, "gap", None))
            continue
        try:
            df = g.query.plan(catalog)
        except QueryError:
            fixed.append((g.name, g.category, "errored", None))
            continue
        answer = g.value(df) if g.value else df
        v = F.col(answer.columns[0]).cast("bigint")
        ok = F.lit(True)
        if g.low is not None:
            ok = ok & (v >= g.low)
        if g.high is not None:
            ok = ok & (v <= g.high)
        rows.append(
            answer.select(
                F.lit(g.name).alias("name"),
                F.lit(g.category).alias("category"),
                F.when(ok, "pass").otherwise("fail").alias("outcome"),
                v.alias("value"),
            )
        )
    if fixed:
        rows.append(
            spark.createDataFrame(
                fixed, "name string, category string, outcome string, value bigint"
            )
        )
    return reduce(DataFrame.unionByName, rows)


def tally(results: DataFrame) -> DataFrame:
    kinds = ("pass", "fail", "errored", "gap")
    return results.groupBy("category").agg(
        *[F.count_if(F.col("outcome") == k).alias(f"n_{k}") for k in kinds]
    )
