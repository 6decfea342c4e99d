"""The best way to split outgoing salaries over several exceptions, in closed form.

An exception's allowance per unit of salary never grows with the salary. So where every exception
also adds a cushion, each salary goes by itself, whatever their number. Without a cushion:

- Salaries of at least four times the scaled amount are allowed a quarter more, rounded down. Together
  they lose no fraction, so they share one exception.
- Every other salary is worth no more in company than alone. Salaries that together stay within the scaled
  amount are worth as much (both are doubled); they share an exception where that loses nothing.
- Without the expanded exception allowances are the salaries themselves: one exception for all, or one each
  where they may not be aggregated.

Which of several equally good splits is reported follows from reading salaries from the last to the first:
a salary joins the newest exception that it fits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factline.functions import constants as K
from factline.functions import rules as R


def shared_exceptions(salaries, scaled) -> F.Column:
    """How many exceptions an array of salaries takes without a cushion, with the expanded one."""
    start = F.struct(F.array().cast("array<bigint>").alias("open"), R.big(0).alias("n"), F.lit(False).alias("large"))

    def add(acc, x):
        large = x >= 4 * scaled
        fits = F.transform(acc["open"], lambda s: s + x <= scaled)
        spot = F.when(x <= scaled, F.array_position(fits, True)).otherwise(0)
        joined = F.transform(acc["open"], lambda s, i: F.when(i == spot - 1, s + x).otherwise(s))
        opened = F.when(x <= scaled, F.concat(F.array(x), acc["open"])).otherwise(acc["open"])
        alone = F.when(large, ~acc["large"]).otherwise(spot == 0)
        return F.struct(
            F.when(large, acc["open"]).when(spot > 0, joined).otherwise(opened).alias("open"),
            (acc["n"] + alone.cast("bigint")).alias("n"),
            (acc["large"] | large).alias("large"),
        )

    return F.aggregate(F.reverse(salaries), start, add, lambda acc: acc["n"])


def best_structures(
    sends: DataFrame,
    legs: DataFrame,
    keys: list[str],
    order: list[str],
    variants: dict[str, tuple[str | None, str | None]] | None = None,
) -> DataFrame:
    """`legs` (one row per key: cushion, salary_cap, base_cap) with `<name>_total` and
    `<name>_groups` per variant, from `sends` (one row per outgoing salary: keys, amount,
    order columns). A variant names the flags that take an exception out (expanded, aggregated).

    One aggregate over the salaries. Only legs without a cushion also need them in order, to count
    exceptions; a leg's salaries are those of one team in one trade.
    """
    variants = variants or {"structure": (None, None)}
    cush, cap, base = F.col("cushion"), F.col("salary_cap"), F.col("base_cap")
    scaled = R.trunc(cap.cast("double") * K.EXPANDED_BASE_AMOUNT / base.cast("double"))
    flags = sorted({f for pair in variants.values() for f in pair if f})
    flag = {name: tuple(F.col(f) if f else F.lit(False) for f in pair) for name, pair in variants.items()}
    x = F.col("amount")
    large = (cush <= 0) & (x >= 4 * scaled)
    alone = {
        name: F.greatest(x + cush, F.when(no_e, R.big(0)).otherwise(R.allow_expanded(x, cush, cap, base)))
        for name, (no_e, _) in flag.items()
    }
    row = F.struct(*order, x.alias("_amount"))
    sums = (
        sends.where("amount > 0")
        .join(legs.select(*keys, "cushion", "salary_cap", "base_cap", *flags), keys)
        .groupBy(*keys)
        .agg(
            F.count("*").alias("n"),
            F.coalesce(F.sum(F.when(large, x)), F.lit(0)).cast("bigint").alias("_large"),
            F.array_sort(F.collect_list(F.when(cush <= 0, row))).alias("_rows"),
            *[F.sum(value).cast("bigint").alias(f"_each_{name}") for name, value in alone.items()],
            *[F.coalesce(F.sum(F.when(~large, value)), F.lit(0)).cast("bigint").alias(f"_small_{name}") for name, value in alone.items()],
        )
    )
    out = legs.join(sums, keys, "left")
    n = F.col("n")
    shared = shared_exceptions(F.col("_rows._amount"), scaled)
    for name, (no_e, no_a) in flag.items():
        merged = F.col(f"_small_{name}") + R.trunc(F.col("_large").cast("double") * K.EXPANDED_FACTOR)
        each = F.col(f"_each_{name}")
        out = out.withColumn(f"{name}_total", F.when((cush > 0) | no_e, each).otherwise(merged)).withColumn(
            f"{name}_groups",
            F.when((cush > 0) | (no_e & no_a), n).when(no_e, F.least(n, F.lit(1))).otherwise(shared),
        )
        for c in ("total", "groups"):
            out = out.withColumn(f"{name}_{c}", F.when(n.isNull(), R.big(0)).otherwise(F.col(f"{name}_{c}")).cast("bigint"))
    return out.drop("n", "_large", "_rows", *[f"_each_{v}" for v in variants], *[f"_small_{v}" for v in variants])
