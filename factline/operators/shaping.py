"""Source shapes to rows: nested JSON, wide grids, page tables, snapshots."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factline.functions import text as X


def _ref(c: Column) -> Column:
    """`Type:id` as the bare id."""
    return F.when(F.contains(c, F.lit(":")), F.regexp_extract(c, "(?s)^[^:]*:(.*)$", 1)).otherwise(c)


def flatten_json(df: DataFrame, column: str, schema: T.StructType) -> DataFrame:
    """One column per leaf of a JSON object: references to their id, nested objects under a
    prefix, lists joined by a pipe. The schema decides the columns, so no data is looked at."""
    leaves: list[Column] = []

    def is_ref(t: T.DataType) -> bool:
        return isinstance(t, T.StructType) and "__ref" in t.fieldNames()

    def walk(t: T.StructType, at: Column, prefix: str) -> None:
        for f in t.fields:
            if f.name == "__typename":
                continue
            c, name = at[f.name], f"{prefix}{f.name}"
            if is_ref(f.dataType):
                leaves.append(_ref(c["__ref"]).alias(name))
            elif isinstance(f.dataType, T.StructType):
                walk(f.dataType, c, f"{name}_")
            elif isinstance(f.dataType, T.ArrayType):
                if is_ref(f.dataType.elementType):
                    items = F.transform(c, lambda x: _ref(x["__ref"]))
                else:
                    items = F.transform(c, lambda x: F.coalesce(x.cast("string"), F.lit("")))
                leaves.append(F.array_join(items, "|").alias(name))
            else:
                leaves.append(c.alias(name))

    walk(schema, F.col("_obj"), "")
    return df.withColumn("_obj", F.from_json(column, schema)).select(*leaves)


def dedup_with_sources(df: DataFrame, key: str, source: str, order: str) -> DataFrame:
    """One row per key: the first by `order`, and every source that showed it.

    (key, source) pairs are made distinct before sources are gathered, so what is gathered
    is bounded by the number of sources, however often one of them repeats a row.
    """
    kept = [c for c in df.columns if c not in (key, source)]
    pairs = df.groupBy(key, source).agg(F.min_by(F.struct(*kept), order).alias("r"))
    return (
        pairs.groupBy(key)
        .agg(
            F.min_by("r", F.col(f"r.{order}")).alias("r"),
            F.array_join(F.array_sort(F.collect_list(source)), "|").alias("_sources"),
        )
        .select(key, "r.*", "_sources")
    )


def union_all_keys(dfs: Iterable[DataFrame]) -> DataFrame:
    """All columns of all inputs: `id` first, names behind an underscore last."""
    out = None
    for df in dfs:
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    names = out.columns
    head = [c for c in names if c == "id"]
    tail = sorted(c for c in names if c.startswith("_"))
    middle = sorted(c for c in names if c not in head and c not in tail)
    return out.select(*head, *middle, *tail)


def extract_tables(
    df: DataFrame,
    html: str,
    needles: Iterable[str],
    table: str = "table",
    header: str = "th",
    row: str = "tr",
    cell: str | None = "td",
) -> DataFrame:
    """Rows of the tables whose headers mention every needle, wherever on the page they are.

    Tags are told in any case and with any attributes; a table inside another one is a table of its own.
    """
    found = df.select(*[c for c in df.columns if c != html], F.inline(X.tables(F.col(html), table, header, row, cell)))
    joined = F.lower(F.array_join("headers", " | "))
    for n in needles:
        found = found.where(F.contains(joined, F.lit(n.lower())))
    keep = [c for c in found.columns if c != "rows"]
    return found.select(*keep, F.inline("rows"))


def unpivot_seasons(df: DataFrame, ids: list[str], columns: list[str], value: str) -> DataFrame:
    """A wide grid as rows; empty cells leave none."""
    return df.unpivot(ids, columns, "season", value).where(F.col(value).isNotNull())


def unpivot_nonempty(df: DataFrame, ids: list[str], columns: list[str], scope: str) -> DataFrame:
    """A trigger matrix as one row per filled cell."""
    return (
        df.unpivot(ids, columns, "category", "detail")
        .where("detail <> ''")
        .withColumn("scope", F.lit(scope))
    )


def select_by_header(df: DataFrame, headers: list[str], wanted: dict[str, list[str]], cells: str) -> DataFrame:
    """Columns out of a cell array, each found by a prefix of its header; null when absent."""
    low = [h.lower() for h in headers]

    def at(prefixes: list[str]) -> int | None:
        return next((i for p in prefixes for i, h in enumerate(low) if h.startswith(p)), None)

    out = []
    for name, prefixes in wanted.items():
        i = at(prefixes)
        c = F.lit(None).cast("string") if i is None else F.nullif(F.get(F.col(cells), F.lit(i)), F.lit(""))
        out.append(c.alias(name))
    return df.select(*[c for c in df.columns if c != cells], *out)


def unpivot_slots(df: DataFrame, ids: list[str], since: int) -> DataFrame:
    """Numbered slot columns as rows, the trailing position split off the name."""
    slots = [c for c in df.columns if c.isdigit()]
    start = F.regexp_extract("season", r"^(\d{4})-\d{2}$", 1).try_cast("int")
    rows = df.where(start >= since).unpivot(ids, slots, "slot", "raw").where("raw is not null")
    return rows.select(
        *ids,
        "slot",
        F.trim(F.regexp_replace("raw", r"\s+[CFG]$", "")).alias("player_name"),
        F.nullif(F.regexp_extract("raw", r"\s+([CFG])$", 1), F.lit("")).alias("position"),
    )


def single_winner(df: DataFrame, award: str, since: int) -> DataFrame:
    start = F.regexp_extract("season", r"^(\d{4})-\d{2}$", 1).try_cast("int")
    return df.where((start >= since) & F.col("player").isNotNull()).select(
        "season", F.lit(award).alias("award"), F.lit("Winner").alias("tier"),
        F.col("player").alias("player_name"),
    )


def snapshot_rank(url: Column, year: int) -> Column:
    """How well a page address names what is wanted; lower is better."""
    return (
        F.when(F.contains(url, F.lit(f"/year/{year}")) | url.rlike(f"/cap/{year}/?$"), 0)
        .when(url.rlike(r"/cap/?$") | url.rlike(r"/cap/?\?"), 1)
        .when(F.contains(url, F.lit("/cap-hit")), 2)
        .when(F.contains(url, F.lit("/year/")) | url.rlike(r"/cap/\d{4}/?$"), 4)
        .otherwise(3)
    )


def pick_snapshot(candidates: DataFrame, year: int) -> DataFrame:
    """The best snapshot per team, as one aggregate.

    Best address form first. Inside it the earliest taken in the year, else the latest of
    all. A page of another year only when nothing else is there: the nearest, then earliest.

    candidates (team, url, ts), ts a digit string starting with the year.
    """
    url, ts = F.col("url"), F.col("ts")
    rank = snapshot_rank(url, year)
    in_year = ts.startswith(str(year))
    seen = F.coalesce(F.regexp_extract(url, r"/(?:year/)?(\d{4})/?$", 1).try_cast("int"), F.lit(9999))
    number = ts.cast("bigint")
    other = rank == 4
    order = F.struct(
        rank.alias("rank"),
        F.when(other, F.abs(seen - year)).otherwise(0).alias("distance"),
        F.when(other | in_year, 0).otherwise(1).alias("outside"),
        F.when(other | in_year, number).otherwise(-number).alias("at"),
        url.alias("url"),
    )
    return candidates.groupBy("team").agg(
        F.min_by(F.struct("url", "ts"), order).alias("s"), F.min(rank).alias("rank")
    ).select("team", "s.url", "s.ts", "rank")
