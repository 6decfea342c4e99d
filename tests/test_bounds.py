"""Inputs beyond what used to be bounds, and rows that used to end a job."""

import html
import random
import sys
import unicodedata

from pyspark.sql import functions as F

from factline.functions import names, text
from factline.operators import audit, documents, ingest, matching, trades

BITS = [
    "&", "&amp", "&amp;", "&lt", "&#0;", "&#x80;", "&#xD800;", "&#xFFFFFFFF;", "&#1114112;", "&#99999999999999999999999;", "&#x", "&#;", "&notit;", "&notin;",
    "&not", "&apos;", "&NotEqualTilde;", "x", ";", "#", "&#12", "&#x1F600;", "&#xfffe;", "&#11;", "&#13;", "&copycat", "é", "&zzz;", " ", "&#00065", "&#x0000041;",
]


def test_entities_as_the_standard_library(spark):
    rnd = random.Random(1)
    rows = BITS + ["".join(rnd.choice(BITS) for _ in range(rnd.randint(1, 6))) for _ in range(200)]
    got = spark.createDataFrame([(t,) for t in rows], ["t"]).select("t", text.unescape(F.col("t")).alias("u")).collect()
    assert [r.u for r in got] == [html.unescape(t) for t in rows]


def test_every_letter_folds(spark):
    letters = [chr(c) for c in range(1, sys.maxunicode + 1, 11) if not 0xD800 <= c < 0xE000]
    rows = ["".join(letters[i : i + 60]) for i in range(0, len(letters), 60)] + ["𝐀lpha", "℡", "ⅷ", "…", "㎏"]
    got = spark.createDataFrame([(t,) for t in rows], ["t"]).select(names.fold_ascii(F.col("t")).alias("u")).collect()
    assert [r.u for r in got] == [unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode() for t in rows]


def test_a_figure_too_large_to_write_out(spark):
    df = spark.createDataFrame([("$99999999999999999999B and $2M",)], ["t"])
    assert df.select(audit.expand_suffixes(F.col("t")).alias("x")).first().x == ["2,000,000", "2000000"]


def test_a_trace_of_any_depth(spark):
    spans = [("t", f"s{i:03}", f"s{i - 1:03}" if i else None, i) for i in range(200)] + [("u", "a", "b", 1), ("u", "b", "a", 2), ("w", "x", "gone", 1)]
    df = spark.createDataFrame(spans, "trace_id string, span_id string, parent_id string, started_at long")
    got = {(r.trace_id, r.span_id): (r.depth, r.place) for r in audit.flatten_spans(df).collect()}
    assert all(got["t", f"s{i:03}"] == (i + 1, i + 1) for i in range(200)) and len(got) == 203


def test_an_outline_of_any_depth(spark):
    levels = [*range(1, 13), 10, 5, 11]
    df = spark.createDataFrame([(1, i, n, f"h{i}", 10 * i, 1000) for i, n in enumerate(levels)], "doc_id long, idx long, level int, title string, start long, doc_end long")
    got = {r.idx: r for r in documents.outline(df).collect()}
    for i, n in enumerate(levels):
        end = next((10 * j for j in range(i + 1, len(levels)) if levels[j] <= n), 1000)
        above = [j for j in range(i) if levels[j] < n and all(levels[k] > levels[j] for k in range(j + 1, i))]
        assert got[i].subtree_end == end and [c.idx for c in got[i].chain] == above


def test_numbering(spark):
    titles = [
        (1, "Preface"), (1, "Article IV Rules"), (2, "Section 3. Terms"), (3, "(a) one"), (4, "(1) x"), (4, "(2) y"), (3, "(b) two"), (4, "(i) r"), (4, "(ii) s"), (4, "(iii)(A) t"), (4, "(B) u"),
        (3, "(z) z"), (3, "(aa) w"), (3, "(bb) v"), (2, "Section 4. More"), (3, "(ix) n"), (3, "(x) m"), (3, "(xi) l"), (3, "plain"), (3, "(a) k"), (4, "(b) under"), (3, "(i) p"), (4, "(ii) q"), (4, "(C) v"),
    ]
    df = spark.createDataFrame([(1, i, n, t) for i, (n, t) in enumerate(titles)], "doc_id long, idx long, level int, title string")
    got = [(r.article, r.section, r.markers) for r in documents.number_units(df).orderBy("idx").collect()]
    assert got[0] == (None, None, "") and got[1] == ("IV", None, "") and got[2] == ("IV", "3", "")
    assert [m for *_, m in got[3:14]] == ["(a)", "(a)(1)", "(a)(2)", "(b)", "(b)(i)", "(b)(ii)", "(b)(iii)(A)", "(b)(B)", "(z)", "(aa)", "(bb)"]
    assert [m for *_, m in got[14:]] == ["", "(ix)", "(x)", "(xi)", "", "(a)", "(b)", "(i)", "(ii)", "(i)(C)"]


def test_units_alike_for_sixty_characters(spark):
    long = "x" * 70
    df = spark.createDataFrame([(None, None, None, long + "a"), (None, None, None, long + "b")], "a string, s string, m string, t string")
    assert df.select(documents.citation(*[F.col(c) for c in "asmt"]).alias("c")).distinct().count() == 2


def test_a_trade_of_many_moves(spark):
    df = spark.createDataFrame([(1, p, 1, 2) for p in range(17)], "trade_id long, player long, from_team long, to_team long")
    assert trades.trade_errors(df).first().error is None and trades.trade_errors(df, 16).first().error == "too_many_moves"


def test_parents_listed_twice(spark):
    df = spark.createDataFrame([(1, 5), (2, 6)], "id long, parent long")
    out = ingest.null_missing_fk(df, "parent", spark.createDataFrame([(5,), (5,)], ["k"]), "k")
    assert sorted((r.id, r.parent) for r in out.collect()) == [(1, 5), (2, None)]


def test_values_are_compared_by_sort(spark):
    a = spark.createDataFrame([(None, 1)], "x string, y long")
    assert not matching.results_equal(a, spark.createDataFrame([("∅", 1)], "x string, y long")).first().equal
    assert matching.results_equal(a, spark.createDataFrame([(1.0, None)], "p double, q string")).first().equal
    assert not matching.results_equal(a, spark.createDataFrame([("1", None)], "p string, q string")).first().equal


def test_figures_move_once_to_their_answer(spark):
    answers = spark.createDataFrame([(1, "it is $1,234 or 55,000 or 12% or 777.5%"), (2, "$1,234"), (None, "$9,999")], "aid long, text string")
    known = spark.createDataFrame([(1, "912349"), (1, "912349"), (1, "5500"), (1, "12"), (3, "1234"), (None, "9999")], "aid long, digits string")
    out = audit.audit_figures(answers, known)
    assert "gram" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.aid or 0, r.pos, r.figure) for r in out.collect()) == [(0, 0, "$9,999"), (1, 1, "55,000"), (1, 3, "777.5%"), (2, 0, "$1,234")]
