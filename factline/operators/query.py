"""A small typed query over a catalog entity, checked before any job runs."""

from __future__ import annotations

import io
from contextlib import redirect_stdout
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factline.operators.catalog import NUMERIC, Catalog, Entity

COMPARISONS = {
    "eq": lambda c, v: c == v,
    "ne": lambda c, v: c != v,
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
}
OPS = (*COMPARISONS, "in", "contains", "is_null", "not_null")
AGGREGATES = {
    "count": F.count,
    "count_distinct": F.count_distinct,
    "sum": F.sum,
    "avg": F.avg,
    "min": F.min,
    "max": F.max,
}


class QueryError(ValueError):
    """What was wrong, and what would have been valid."""

    def __init__(self, message: str, allowed: list[str] | None = None):
        self.allowed = sorted(allowed or [])
        if self.allowed:
            message = f"{message}. Allowed: {', '.join(self.allowed)}"
        super().__init__(message)


@dataclass(frozen=True)
class Filter:
    field: str
    op: str
    value: Any = None


@dataclass(frozen=True)
class Projection:
    field: str
    agg: str | None = None
    alias: str | None = None

    @property
    def output(self) -> str:
        return self.alias or (f"{self.agg}_{self.field}" if self.agg else self.field)

    @property
    def counts_rows(self) -> bool:
        return self.field == "*" and self.agg == "count"


@dataclass(frozen=True)
class Order:
    field: str
    descending: bool = False


@dataclass(frozen=True)
class Query:
    entity: str
    select: tuple[Projection, ...]
    filters: tuple[Filter, ...] = ()
    group_by: tuple[str, ...] = ()
    order_by: tuple[Order, ...] = ()
    limit: int | None = None

    def validate(self, catalog: Catalog) -> Entity:
        ent = catalog.entities.get(self.entity)
        if ent is None:
            raise QueryError(f"unknown entity {self.entity!r}", list(catalog.entities))
        if not self.select:
            raise QueryError(f"nothing selected from {self.entity!r}", ent.field_names)
        if self.limit is not None and self.limit < 1:
            raise QueryError(f"limit must be 1 or more, got {self.limit}")
        outputs = [p.output for p in self.select]
        wanted = [("field", p.field) for p in self.select if not p.counts_rows]
        wanted += [("filter field", f.field) for f in self.filters]
        wanted += [("group_by field", g) for g in self.group_by]
        for what, name in wanted:
            if ent.field(name) is None:
                raise QueryError(f"unknown {what} {name!r} on {self.entity!r}", ent.field_names)
        for o in self.order_by:
            if ent.field(o.field) is None and o.field not in outputs:
                raise QueryError(
                    f"unknown order_by field {o.field!r}", [*ent.field_names, *outputs]
                )
        for p in self.select:
            if p.agg is not None and p.agg not in AGGREGATES:
                raise QueryError(f"unknown aggregate {p.agg!r}", list(AGGREGATES))
            if p.agg in ("sum", "avg") and ent.field(p.field).type not in NUMERIC:
                raise QueryError(
                    f"{p.agg} needs a numeric field, {p.field!r} is {ent.field(p.field).type}",
                    [f.name for f in ent.fields if f.type in NUMERIC],
                )
        for f in self.filters:
            if f.op not in OPS:
                raise QueryError(f"unknown operator {f.op!r}", list(OPS))
            if f.op in ("is_null", "not_null"):
                if f.value is not None:
                    raise QueryError(f"{f.op} takes no value")
            elif f.value is None:
                raise QueryError(f"{f.op} requires a value")
            elif f.op == "in" and not isinstance(f.value, (list, tuple)):
                raise QueryError("'in' requires a list of values")
        grouped = bool(self.group_by) or any(p.agg for p in self.select)
        loose = [p.field for p in self.select if not p.agg and p.field not in self.group_by]
        if grouped and loose:
            # A column outside the grouping has no single value; nor has an ordering by one.
            raise QueryError(
                f"{', '.join(loose)} must be grouped or aggregated", list(self.group_by) or loose
            )
        if grouped:
            known = {*self.group_by, *outputs}
            for o in self.order_by:
                if o.field not in known:
                    raise QueryError(f"cannot order groups by {o.field!r}", sorted(known))
        return ent

    # -- plans -------------------------------------------------------------

    def filtered(self, catalog: Catalog) -> DataFrame:
        """The rows selected, shared by the result and its provenance."""
        ent = self.validate(catalog)
        df = ent.frame
        for f in self.filters:
            df = df.where(condition(ent.field(f.field).expr, f))
        return df

    def plan(self, catalog: Catalog) -> DataFrame:
        ent = self.validate(catalog)
        rows = self.filtered(catalog)
        expr = {f.name: f.expr for f in ent.fields}

        def projected(p: Projection) -> Column:
            if p.counts_rows:
                return F.count("*").alias(p.output)
            c = expr[p.field]
            return (AGGREGATES[p.agg](c) if p.agg else c).alias(p.output)

        if self.group_by or any(p.agg for p in self.select):
            keys = [expr[g].alias(f"_g{i}") for i, g in enumerate(self.group_by)]
            aggs = [projected(p) for p in self.select if p.agg]
            grouped = rows.groupBy(*keys).agg(*(aggs or [F.count("*").alias("_n")]))
            place = {g: F.col(f"_g{i}") for i, g in enumerate(self.group_by)}
            out = [
                F.col(p.output) if p.agg else place[p.field].alias(p.output) for p in self.select
            ]
            # In an ordering a catalog field wins over an output of the same name.
            order = [_sorted(place.get(o.field, F.col(o.field)), o) for o in self.order_by]
            result = grouped.orderBy(*order).select(*out) if order else grouped.select(*out)
        else:
            order = [
                _sorted(expr.get(o.field, _aliased(self.select, o.field, expr)), o)
                for o in self.order_by
            ]
            picked = [projected(p) for p in self.select]
            result = rows.orderBy(*order).select(*picked) if order else rows.select(*picked)
        return result if self.limit is None else result.limit(self.limit)


def _aliased(select: tuple[Projection, ...], name: str, expr: dict[str, Column]) -> Column | None:
    return next((expr[p.field] for p in select if p.output == name), None)


def _sorted(c: Column, o: Order) -> Column:
    """Nulls first ascending, last descending."""
    return c.desc_nulls_last() if o.descending else c.asc_nulls_first()


def condition(c: Column, f: Filter) -> Column:
    if f.op == "is_null":
        return c.isNull()
    if f.op == "not_null":
        return c.isNotNull()
    if f.op == "in":
        return c.isin(*f.value)
    if f.op == "contains":
        # `%` and `_` in the value keep their wildcard meaning.
        return c.cast("string").ilike(f"%{f.value}%")
    return COMPARISONS[f.op](c, F.lit(f.value))


@dataclass
class QueryResult:
    """A lazy result with the plan behind it and where its rows came from."""

    query: Query
    df: DataFrame
    provenance: DataFrame
    parameters: list[Any] = field(default_factory=list)

    @property
    def statement(self) -> str:
        text = io.StringIO()
        with redirect_stdout(text):
            self.df.explain("formatted")
        return text.getvalue()

    def scalar(self) -> Any:
        rows = self.df.take(1)
        return rows[0][0] if rows else None


def run(catalog: Catalog, query: Query, source_dates: DataFrame) -> QueryResult:
    from factline.operators.provenance import observe

    values: list[Any] = []
    for f in query.filters:
        values.extend(f.value if f.op == "in" else [] if f.value is None else [f.value])
    return QueryResult(
        query, query.plan(catalog), observe(catalog, query, source_dates), values
    )
