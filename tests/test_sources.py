import hashlib
import json

import pytest
from pyspark.sql import functions as F

from factline.functions import names as N
from factline.functions import text as X
from factline.operators import ingest, shaping
from factline.sources import files


def test_missing_csv_is_an_empty_table(spark, tmp_path):
    assert files.read_csv_or_empty(spark, str(tmp_path / "none.csv"), ["a", "b"]).columns == ["a", "b"]
    (tmp_path / "x.csv").write_text("b,a\n2,1\n")
    row = files.read_csv_or_empty(spark, str(tmp_path / "x.csv"), ["b", "a"]).collect()[0]
    assert (row.a, row.b) == ("1", "2")


def test_manifest_dates(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"scraped_at": "2026-09-01T10:00:00+00:00", "rows": 3}))
    (tmp_path / "n.json").write_text(json.dumps({"rows": 3}))
    got = files.source_dates(spark, {"a": str(tmp_path / "m.json"), "b": str(tmp_path / "n.json"), "c": str(tmp_path / "o.json")})
    assert [tuple(r) for r in got.collect()] == [("a", "2026-09-01")]


def test_pinned_files(spark, tmp_path):
    for n in ("good", "bad", "extra"):
        (tmp_path / n).write_bytes(n.encode())
    found = files.read_binary(spark, str(tmp_path)).withColumn("path", F.element_at(F.split("path", "/"), -1))
    pins = [("good", 4, hashlib.sha256(b"good").hexdigest()), ("bad", 3, "0" * 64)]
    got = files.verify_pinned(found, spark.createDataFrame(pins, "path string, size long, sha256 string"))
    assert {r.path: r.reason for r in got.collect()} == {"good": None, "bad": "hash_mismatch", "extra": "not_pinned"}


def test_tables_by_header_not_position(spark):
    page = (
        "<table><tr><th>Other</th></tr><tr><td>x</td></tr></table>"
        "<table class='t'><tr><th>Player</th><th>Cap Hit</th></tr><tr><td>A &amp;amp; B</td><td>$1,000</td></tr></table>"
    )
    df = spark.createDataFrame([(1, page)], "id long, html string")
    rows = shaping.extract_tables(df, "html", ["player", "cap hit"]).collect()
    assert [r.cells for r in rows] == [["A &amp; B", "$1,000"]]


def test_text_helpers(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).collect()[0]["v"]
    assert one(X.unescape(F.lit("&#8212;&#x41;&eacute;&nope;&lt;"))) == "—Aé&nope;<"
    assert one(X.parse_money(F.lit("-$1,234"))) == -1234
    assert one(X.parse_money(F.lit("n/a"), F.lit("77"))) == 77
    assert one(X.as_int(F.lit("3.9"))) == 3 and one(X.as_int(F.lit(""))) is None
    assert one(X.figures_in(F.lit("$1,000 and 125 % of 7,500,000 and $1,000"))) == ["$1,000", "125 %", "7,500,000"]
    assert one(N.normalise_name(F.lit("Luka Dončić Jr."))) == "luka doncic"
    assert one(N.normalise_name(F.lit("O'Neal-Smith III"))) == "oneal smith"


def test_identities_keep_first_name_and_first_ids(spark):
    obs = spark.createDataFrame(
        [("k", "B", "y", 2, 5, None), ("k", "A", "x", 1, None, "q"), ("k", "C", "x", 3, 6, "r"), ("", "D", "x", 4, 1, None)],
        "key string, name string, source string, seq long, id_a long, id_b string",
    )
    assert [tuple(r) for r in ingest.resolve_identities(obs).collect()] == [("k", "A", 5, "q", "x|y")]


def test_bad_override_fails_loudly(spark):
    o = spark.createDataFrame([(2, 2029, 1, 1, "forfeit", "", "n")], "line long, year long, original_team long, owner long, action string, citation_url string, note string")
    with pytest.raises(Exception, match="line 2"):
        ingest.validate_overrides(o).collect()


def test_surrogate_ids_are_dense(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1009).alias("v"))
    rows = ingest.with_surrogate_id(df, ["v"], partitions=7).orderBy("v").collect()
    assert [r.id for r in rows] == list(range(1, 1001))


def test_tables_inside_tables_in_any_case(spark):
    page = (
        "<!-- <table> --><TABLE class='a>b'><Tr><TH>Name</TH><th>A &amp; B</th></tr>"
        "<tr><td title=\"x > y\">one<br>two</td><TD>out<table><tr><th>Inner</th></tr><tr><td>deep</td></table>side</td></tr>"
        "<tr><td>open<td>next<tr></tr><tr><td>last</td></TABLE> tail <table><tr><th>Name</th></tr><tr><td>never closed"
    )
    df = spark.createDataFrame([(1, page), (2, None), (3, "no table"), (4, "")], "page long, html string")
    got = [(r.page, r.table_no, r.headers, r.row_no, r.cells) for r in shaping.extract_tables(df, "html", ["name"]).collect()]
    assert got == [
        (1, 0, ["Name", "A & B"], 1, ["one two", "outside"]),
        (1, 0, ["Name", "A & B"], 2, ["open", "next"]),
        (1, 0, ["Name", "A & B"], 4, ["last"]),
        (1, 2, ["Name"], 1, ["never closed"]),
    ]
    inner = shaping.extract_tables(df, "html", ["inner"]).collect()
    assert [(r.table_no, r.row_no, r.cells) for r in inner] == [(1, 1, ["deep"])]
