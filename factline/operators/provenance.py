"""Where rows came from, and when each source was observed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factline.operators.catalog import Catalog


def observed(rows: DataFrame, source: Column, as_of: Column | None, source_dates: DataFrame) -> DataFrame:
    """One row per source and basis: the row's own date, the date the source was read, or neither.

    `source_dates` (source, scraped) has one row per source, as has the aggregate it joins.
    """
    when = as_of if as_of is not None else F.lit(None).cast("date")
    sums = rows.groupBy(source.cast("string").alias("source")).agg(
        F.count("*").alias("total"),
        F.count(when).alias("dated"),
        F.min(when).alias("earliest"),
        F.max(when).alias("latest"),
    )
    undated = F.col("total") - F.col("dated")
    bases = F.array(
        F.when(
            F.col("dated") > 0,
            F.struct(
                F.col("dated").alias("rows"), F.lit("row").alias("basis"),
                F.col("earliest").cast("string").alias("earliest"),
                F.col("latest").cast("string").alias("latest"),
            ),
        ),
        F.when(
            undated > 0,
            F.struct(
                undated.alias("rows"),
                F.when(F.col("scraped").isNotNull(), "scraped").otherwise("undated").alias("basis"),
                F.col("scraped").cast("string").alias("earliest"),
                F.col("scraped").cast("string").alias("latest"),
            ),
        ),
    )
    return (
        sums.join(source_dates, "source", "left")
        .select("source", F.explode(bases).alias("b"))
        .where("b is not null")
        .select("source", "b.rows", "b.basis", "b.earliest", "b.latest")
    )


def observe(catalog: Catalog, query, source_dates: DataFrame) -> DataFrame:
    """Provenance of the rows a query selects; its limit does not apply."""
    ent = query.validate(catalog)
    source = ent.source if ent.source is not None else F.lit(ent.name)
    return observed(query.filtered(catalog), source, ent.as_of, source_dates)


def describe(df: DataFrame) -> DataFrame:
    """`events, as of 2024-01-01 to 2024-01-30 (10 rows)` and the like."""
    span = F.when(
        F.col("earliest") != F.col("latest"),
        F.concat("earliest", F.lit(" to "), "latest"),
    ).otherwise(F.col("earliest"))
    count = F.concat(F.lit(" ("), F.col("rows").cast("string"), F.lit(" rows)"))
    verb = F.when(F.col("basis") == "scraped", "scraped").otherwise("as of")
    return df.withColumn(
        "text",
        F.when(
            F.col("basis") == "undated", F.concat("source", F.lit(", date unknown"), count)
        ).otherwise(F.concat("source", F.lit(", "), verb, F.lit(" "), span, count)),
    )


def snapshot(meta: DataFrame) -> DataFrame:
    """The build record as one row; a missing key stays null."""

    def value(key: str) -> Column:
        return F.get_json_object(F.max(F.when(F.col("key") == key, F.col("value"))), "$")

    return meta.agg(
        value("built_at").alias("built_at"),
        value("season").alias("season"),
        F.max(F.when(F.col("key") == "source_dates", F.col("value"))).alias("source_dates"),
    )
