"""Lines are masked once, however many columns and filters ask for the masked line."""

from pyspark.sql import functions as F

from factline.llm import line_dedup as L


def test_lines_are_masked_once(spark):
    docs = spark.createDataFrame([(1, "a b 7 d\nx y\n\ne  f g h i"), (2, None), (3, "")], "doc_id long, text string")
    rows = L.hashed(L.lines(docs, "text"))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("RLIKE") == 1
    assert sorted((r.line, r.m) for r in rows.collect()) == [(0, "a b <*> d"), (3, "e f g h i")]


def test_white_space_is_settled_once_a_text(spark):
    docs = spark.createDataFrame([(1, " a\t7x  d \r\nx \x0b y z 9\n a  b c  "), (2, "a b c d")], "doc_id long, text string")
    rows = docs.select("doc_id", L.masked(F.col("text")).alias("m"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    inner = plan[plan.index("lambdafunction") :]
    assert "Contains" not in inner and "contains" not in inner.split("split(")[0] and plan.count("regexp_replace(lambda") == 1
    assert [r.m for r in rows.orderBy("doc_id").collect()] == [["a <*> d", "x y z <*>", "a b c"], ["a b c d"]]
