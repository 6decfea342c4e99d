"""One entry per operator: the Spark query and the SQL it must equal."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factline.plans.views import Views
from factline.plans.views_sql import VIEWS


def tidy(df: DataFrame) -> DataFrame:
    """Stable result types: whole numbers as bigint, dates as ISO text."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        out.append(c.alias(f.name))
    return df.select(*out)


def with_views(sql: str) -> str:
    """Prepend the derived views a statement names, in dependency order."""
    needed: list[str] = []
    seen: set[str] = set()

    def visit(text: str) -> None:
        for name in sorted(set(re.findall(r"\bf_\w+", text))):
            if name in VIEWS and name not in seen:
                seen.add(name)
                visit(VIEWS[name])
                needed.append(name)

    visit(sql)
    body = sql.strip()
    if not needed:
        return body
    views = ",\n".join(f"{n} AS (\n{VIEWS[n].strip()}\n)" for n in needed)
    own = re.match(r"with\s+(recursive\s)?", body, re.I)
    recursive = bool({"f_parts", "f_reached"} & set(needed)) or (own is not None and own.group(1) is not None)
    head = "WITH RECURSIVE" if recursive else "WITH"
    if own:
        return f"{head} {views},\n{body[own.end():]}"
    return f"{head} {views}\n{body}"


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def wrap(fn: Callable[[Views], DataFrame]):
            assert name not in self.queries, name
            self.queries[name] = lambda spark, sf_dir: tidy(fn(Views(spark, sf_dir)))
            if sql is not None:
                self.oracles[name] = with_views(sql)
            return fn

        return wrap
