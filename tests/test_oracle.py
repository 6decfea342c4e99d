"""A few queries of every group beside their SQL; `check.py` runs them all."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from check import norm
from tests.conftest import DATA

SOME = [
    "a04_dedup_with_sources", "a07_strip_tags", "a12_pick_snapshot", "b04_resolve_identities",
    "b08_disagreements", "b13_surrogate_id", "c14_contains", "c19_limit", "c22_observe",
    "d14_team_state", "d23_money_text", "e06_best_allowance", "e16_trade_eligibility",
    "f02_trade_errors", "f19_tradeable_years", "g01_parse_legs", "h05_unit_spans", "h11_chunk",
    "i03_bm25", "j01_audit_figures", "j12_usage_report", "j16_flatten_spans", "k01_rate_limit",
    "k02_capped_admission", "k05_usage_stream", "a06_extract_tables", "a16_publish", "f04_post_salary", "g10_score", "h04_locate_units",
    "h06_number_units", "h15_definition_names", "h16_terms_in", "h17_relevant_definitions", "i04_search", "i07_retrieve", "i14_named_lookup",
]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def rows(table, cols):
    return sorted(zip(*[[norm(v) for v in table.column(c).to_pylist()] for c in cols]))


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, db, name):
    got = entry.queries()[name](spark, DATA).toArrow()
    want = db.execute(entry.oracle_sql()[name]).to_arrow_table()
    cols = sorted(got.column_names)
    assert cols == sorted(want.column_names)
    assert rows(got, cols) == rows(want, cols)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 10
