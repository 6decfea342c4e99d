"""Reconciling what several sources say: identity, precedence, merges, overrides, invariants."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factline.sources.scratch import checkpoint

# -- identity --------------------------------------------------------------


def resolve_identities(obs: DataFrame) -> DataFrame:
    """One row per key: the first name seen, the first id in each id space, every source.

    obs: key, name, source, seq, id_a, id_b; nulls where an observation has no id.
    """
    return (
        obs.where("key <> ''")
        .groupBy("key")
        .agg(
            F.min_by("name", "seq").alias("display_name"),
            F.min_by("id_a", F.when(F.col("id_a").isNotNull(), F.col("seq"))).alias("id_a"),
            F.min_by("id_b", F.when(F.col("id_b").isNotNull(), F.col("seq"))).alias("id_b"),
            F.array_join(F.array_sort(F.collect_set("source")), "|").alias("sources"),
        )
    )


def unresolved(ids: DataFrame) -> DataFrame:
    return ids.where("id_a is null and id_b is null").select("key", "sources")


def resolution_summary(ids: DataFrame) -> DataFrame:
    a, b = F.col("id_a").isNotNull(), F.col("id_b").isNotNull()
    return ids.agg(
        F.count("*").alias("identities"),
        F.count_if(a).alias("with_a"),
        F.count_if(b).alias("with_b"),
        F.count_if(a & b).alias("cross_linked"),
        F.count_if(~a & ~b).alias("unresolved"),
    )


# -- precedence ------------------------------------------------------------

UNRANKED = 1_000_000


def _ranked(cands: DataFrame, precedence: DataFrame) -> DataFrame:
    """Present candidates with their rank; an unranked source follows in arrival order."""
    present = cands.where("value is not null and value <> ''")
    return present.join(precedence, ["field", "source"], "left").withColumn(
        "order", F.coalesce(F.col("rank"), F.lit(UNRANKED) + F.col("arrival"))
    )


def reconcile(cands: DataFrame, precedence: DataFrame) -> DataFrame:
    """The winning value per (field, subject), whether sources differed, and the losers.

    cands: field, subject, source, value (text of one declared type), arrival.
    Of several candidates of one source the first in order stands for it.
    """
    entries = F.array_sort(F.collect_list(F.struct("order", "source", "value")))
    return (
        _ranked(cands, precedence)
        .groupBy("field", "subject")
        .agg(
            F.min_by(F.struct("source", "value"), "order").alias("w"),
            (F.min("value") != F.max("value")).alias("disagrees"),
            entries.alias("listed"),
        )
        .withColumn("all", F.filter("listed", lambda x, i: F.array_position(F.col("listed.source"), x["source"]) == i + 1))
        .select(
            "field",
            "subject",
            F.col("w.source").alias("chosen"),
            F.col("w.value").alias("chosen_value"),
            "disagrees",
            F.to_json(
                F.map_from_entries(
                    F.transform(
                        F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(0))),
                        lambda x: F.struct(x["source"], x["value"]),
                    )
                )
            ).alias("others"),
        )
    )


def resolve_field(cands: DataFrame, precedence: DataFrame) -> DataFrame:
    return (
        _ranked(cands, precedence)
        .groupBy("field", "subject")
        .agg(F.min_by(F.struct("source", "value"), "order").alias("w"))
        .select("field", "subject", F.col("w.source").alias("chosen"), F.col("w.value").alias("chosen_value"))
    )


def disagreements(cands: DataFrame, precedence: DataFrame) -> DataFrame:
    return reconcile(cands, precedence).where("disagrees").drop("disagrees")


def reconcile_summary(cands: DataFrame, precedence: DataFrame) -> DataFrame:
    """Agreements and disagreements by field, and in total under a null field."""
    per_subject = (
        _ranked(cands, precedence)
        .groupBy("field", "subject")
        .agg((F.min("value") != F.max("value")).alias("disagrees"))
    )
    return per_subject.rollup("field").agg(
        F.count_if(~F.col("disagrees")).alias("agreements"),
        F.count_if("disagrees").alias("disagreements"),
    )


# -- payroll merge ---------------------------------------------------------


def merge_payroll(listed: DataFrame, payroll: DataFrame, season: int) -> DataFrame:
    """Contract years after the current payroll has had its say, tagged by what happened.

    listed (player, team, season, salary): one row per contract year, several years each.
    payroll (player, team, amount): one row per contract of the current season.
    Outcomes: kept, overruled (payroll's figure differs), confirmed, added (season missing),
    payroll_only, and dropped for every year of a contract listed now but on no payroll.
    """
    keys = ["player", "team"]
    current = F.col("season") == season
    contract = W.partitionBy(*keys)
    years = listed.select(
        *keys, "season", "salary",
        F.max(F.when(current & (F.col("salary") != 0), F.col("salary"))).over(contract).alias("listed_now"),
        F.max(current).over(contract).alias("has_now"),
        # What the payroll adds to a contract comes out beside one of its years, so that years are read once.
        (F.row_number().over(contract.orderBy("season")) == 1).alias("first"),
        F.lit(True).alias("is_listed"),
    )
    paid = payroll.select(*keys, F.col("amount").alias("paid"), F.lit(True).alias("is_paid"))
    both = years.join(paid, keys, "full")
    dropped = F.col("listed_now").isNotNull() & F.col("paid").isNull()
    outcome = (
        F.when(dropped, "dropped")
        .when(~current | F.col("paid").isNull(), "kept")
        .when(F.col("salary") == F.col("paid"), "confirmed")
        .otherwise("overruled")
    )
    figure = F.when(current & F.col("paid").isNotNull(), F.col("paid")).otherwise(F.col("salary"))
    missing = F.col("is_paid") & (F.col("is_listed").isNull() | (F.col("first") & ~F.coalesce("has_now", F.lit(False))))

    def row(season: Column, salary: Column, listed: Column, outcome: Column) -> Column:
        return F.struct(
            season.cast("bigint").alias("season"), salary.alias("salary"), listed.alias("listed"), outcome.alias("outcome")
        )

    none = F.lit(None).cast("bigint")
    rows = F.array(
        F.when(F.col("is_listed"), row(F.col("season"), figure, F.col("salary"), outcome)),
        F.when(missing, row(F.lit(season), F.col("paid"), none, F.when(F.col("has_now").isNull(), "payroll_only").otherwise("added"))),
    )
    return both.select(*keys, F.explode(F.array_compact(rows)).alias("r")).select(*keys, "r.*")


def payroll_log(merged: DataFrame, season: int) -> DataFrame:
    """Every place the payroll overruled the listing, one row per contract."""
    return merged.where(
        (F.col("season") == season) & F.col("outcome").isin("dropped", "overruled")
    ).select(
        "player",
        "team",
        "outcome",
        F.when(F.col("outcome") == "overruled", F.col("salary")).alias("chosen"),
        F.col("listed").alias("other"),
    )


# -- keys ------------------------------------------------------------------


def dedup_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row per key in arrival order, as one aggregate."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("r")
    ).select(*keys, "r.*")


def upsert_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row written per key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct(*order)).alias("r")
    ).select(*keys, "r.*")


def with_surrogate_id(
    df: DataFrame, order: list[str], name: str = "id", partitions: int | None = None
) -> DataFrame:
    """Dense ids 1..n in `order`, without one global sort task.

    Rows are range-partitioned and sorted, then written to the checkpoint so that both
    passes see the same partitions. The running row number of a partition comes from
    `monotonically_increasing_id`; the only thing gathered is one count per partition.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = checkpoint(
        df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    ).withColumn("_at", F.monotonically_increasing_id())
    part = F.shiftright("_at", 33)
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    placed = placed.withColumn("_part", part).withColumn("_inside", inside)
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = sizes.select(
        "_part",
        F.coalesce(
            F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
        ).alias("_offset"),
    )
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.col("_inside") + 1)
        .drop("_at", "_part", "_inside", "_offset")
    )


def null_missing_fk(df: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """A foreign key kept only when its parent exists."""
    p = parents.select(F.col(parent_key).alias("_parent")).distinct()
    return df.join(p, F.col(key) == F.col("_parent"), "left").withColumn(key, F.col("_parent")).drop("_parent")


# -- overrides -------------------------------------------------------------

ACTIONS = ("forfeit",)
OVERRIDE_KEY = ["year", "round", "original_team", "owner"]


def override_errors(overrides: DataFrame) -> DataFrame:
    """Malformed overrides with their line: no citation, or an action not supported."""
    cited = F.trim(F.coalesce("citation_url", F.lit(""))) != ""
    error = F.when(~cited, "no_citation").when(
        ~F.trim("action").isin(*ACTIONS), "unsupported_action"
    )
    return overrides.withColumn("error", error).where("error is not null")


def validate_overrides(overrides: DataFrame) -> DataFrame:
    """The overrides, or a failed job naming the line: a silent override is worse than none."""
    cited = F.trim(F.coalesce("citation_url", F.lit(""))) != ""
    good = cited & F.trim("action").isin(*ACTIONS)
    problem = F.raise_error(F.concat(F.lit("bad override at line "), F.col("line").cast("string")))
    return overrides.withColumn("action", F.when(good, F.trim("action")).otherwise(problem))


def apply_overrides(picks: DataFrame, overrides: DataFrame) -> DataFrame:
    """Picks with asserted facts on top, each saying that it is an assertion."""
    text = F.concat(
        F.lit("OVERRIDE forfeit: "), F.col("note"), F.lit(" ("), F.col("citation_url"), F.lit(")")
    )
    asserted = overrides.groupBy(*OVERRIDE_KEY).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", text.alias("t")))), lambda x: x["t"]), " | ").alias("asserted")
    )
    return (
        picks.join(asserted, OVERRIDE_KEY, "left")
        .withColumn("forfeited", F.col("forfeited") | F.col("asserted").isNotNull())
        .withColumn(
            "protection_text",
            F.nullif(F.concat_ws(" | ", "protection_text", "asserted"), F.lit("")),
        )
        .drop("asserted")
    )


def unmatched_overrides(picks: DataFrame, overrides: DataFrame) -> DataFrame:
    return overrides.join(picks, OVERRIDE_KEY, "left_anti")


# -- checks ----------------------------------------------------------------


def expect_none(violators: DataFrame, name: str) -> DataFrame:
    """An invariant as the rows that break it; it holds when there are none."""
    return violators.withColumn("invariant", F.lit(name))


def expect_logged(dropped: DataFrame, log: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Dropped subjects that are in no log, or that are still there."""
    silent = dropped.join(log, keys, "left_anti").withColumn("problem", F.lit("not_logged"))
    still = dropped.join(present, keys, "left_semi").withColumn("problem", F.lit("still_present"))
    return silent.unionByName(still).select(*keys, "problem")


def ingest_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(
        DataFrame.unionByName,
        [df.agg(F.count("*").alias("n")).withColumn("table_name", F.lit(n)) for n, df in tables.items()],
    )


def build_meta(
    built: DataFrame, season: str, source_dates: DataFrame, counts: DataFrame | None = None
) -> DataFrame:
    """The build record as (key, value), values as JSON.

    built has one row (built_at); source_dates and counts one row per source or table.
    """

    def quoted(c: Column) -> Column:
        return F.concat(F.lit('"'), c, F.lit('"'))

    def as_map(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
        entries = F.array_sort(F.collect_list(F.struct(key, value)))
        return df.agg(F.to_json(F.map_from_entries(entries)).alias("value")).select(
            F.lit(name).alias("key"), "value"
        )

    rows = built.select(F.lit("built_at").alias("key"), quoted(F.col("built_at")).alias("value"))
    rows = rows.unionByName(
        built.select(F.lit("season").alias("key"), quoted(F.lit(season)).alias("value"))
    ).unionByName(as_map(source_dates, "source", "scraped", "source_dates"))
    if counts is not None:
        rows = rows.unionByName(as_map(counts, "table_name", "n", "counts"))
    return rows
