"""Typed queries are checked before any job, and say what would have been valid."""

import pytest

from factline.operators.query import Filter, Order, Projection, Query, QueryError, run
from factline.plans.catalog_queries import FLAGSHIP, catalog, source_dates


def P(*a):
    return Projection(*a)


BAD = [
    (Query("contracts", (P("team"),)), "unknown entity"),
    (Query("seasons", ()), "nothing selected"),
    (Query("seasons", (P("season"),), limit=0), "limit must be"),
    (Query("seasons", (P("agent"),)), "salary_cap"),
    (Query("seasons", (P("season", "sum"),)), "numeric field"),
    (Query("seasons", (P("season"),), (Filter("season", "eq"),)), "requires a value"),
    (Query("seasons", (P("season"),), (Filter("season", "is_null", 1),)), "takes no value"),
    (Query("seasons", (P("season"),), (Filter("season", "in", "x"),)), "list of values"),
    (Query("seasons", (P("season"),), order_by=(Order("nope"),)), "unknown order_by"),
    (Query("seasons", (P("season"), P("salary_cap", "max"))), "grouped or aggregated"),
    (Query("draft_picks", (P("year"), P("team"), P("*", "count")), group_by=("team",)), "year must be grouped"),
]


@pytest.mark.parametrize("query,words", BAD)
def test_rejected_with_what_is_allowed(views, query, words):
    with pytest.raises(QueryError, match=words):
        query.validate(catalog(views))


def test_default_alias():
    assert Projection("salary", "sum").output == "sum_salary"


def test_run_carries_plan_parameters_and_provenance(views):
    out = run(catalog(views), FLAGSHIP, source_dates(views))
    assert out.parameters == ["1999-2000"]
    assert "Physical Plan" in out.statement
    assert {r.basis for r in out.provenance.collect()} == {"row"}
    assert out.scalar() is not None


def test_catalog_lists_every_field(spark, views):
    c = catalog(views)
    rows = c.describe(spark).collect()
    assert len(rows) == sum(len(e.fields) for e in c.entities.values())


def test_order_by_name_shared_with_output(views):
    q = Query("draft_picks", (P("year"), P("team", "count", "n")), group_by=("year",), order_by=(Order("n", True), Order("year")))
    years = [r.year for r in q.plan(catalog(views)).collect()]
    assert years == sorted(years)
