"""Answer audits, run reports, usage, and the order-dependent feeds."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from factline.operators import audit as A
from factline.operators import ordered as O
from factline.plans.registry import Registry
from factline.plans.views import cents
from factline.sources import files, scratch, snapshots
from factline.sources.tables import spread
from factline.streaming import feeds

REG = Registry()
C = F.col

# -- derived inputs --------------------------------------------------------


def answers(v):
    """One answer per order, stating its total, a share of it, and a figure of its own."""
    total = cents(C("o_totalprice"))
    text = F.concat(
        F.lit("The total is $"), F.format_number(total, 0), F.lit(" and that is "),
        (C("o_custkey") % 90 + 10).cast("string"), F.lit("% of "), F.format_number(total * 3, 0),
        F.lit(" under Art. VII  §"), F.month("o_orderdate").cast("string"), F.lit("(a), and not $"),
        F.format_number(C("o_orderkey") + 1000, 0),
    )
    return spread(v.orders).select(C("o_orderkey").alias("aid"), text.alias("text"))


ANSWERS = """an AS (SELECT o_orderkey AS aid, CAST(round(o_totalprice * 100) AS BIGINT) AS total, o_custkey % 90 + 10 AS pct, month(o_orderdate) AS mo,
 'The total is $' || format('{:,}', CAST(round(o_totalprice * 100) AS BIGINT)) || ' and that is ' || (o_custkey % 90 + 10) || '% of ' || format('{:,}', CAST(round(o_totalprice * 100) AS BIGINT) * 3) ||
 ' under Art. VII  §' || month(o_orderdate) || '(a), and not $' || format('{:,}', o_orderkey + 1000) AS text FROM orders)"""


def results(v):
    """Tool results: one row of figures per line, and the order's own."""
    line = spread(v.lines).select(
        C("order_id").alias("aid"), C("contract_id").alias("call"),
        F.to_json(F.struct(F.array(F.struct("cap_figure", C("contract_id").alias("id"))).alias("rows"))).alias("json"),
    )
    order = v.orders.where("o_orderstatus <> 'P'").select(
        C("o_orderkey").alias("aid"), F.lit("order").alias("call"),
        F.to_json(
            F.struct(
                F.struct(cents(C("o_totalprice")).alias("total"), F.lit("none").alias("note")).alias("team"),
                F.array(cents(C("o_totalprice")) * 3, F.lit(7)).alias("n"),
            )
        ).alias("json"),
    )
    return line.unionByName(order)


def known(v):
    quoted = v.orders.where("o_orderpriority = '5-LOW'").select(
        C("o_orderkey").alias("aid"),
        F.concat(F.lit("up to $9"), F.format_number(C("o_orderkey") + 1000, 0), F.lit("9 or 12%")).alias("text"),
    )
    asked = v.orders.where("o_orderpriority = '2-HIGH'").select(
        C("o_orderkey").alias("aid"),
        F.concat(F.lit("is it $"), ((C("o_orderkey") + 1000) / 1000).cast("string"), F.lit("k or $3M?")).alias("text"),
    )
    return A.known_figures(results(v), quoted, asked)


# Figures of the first kind repeat the order's total; the second kind is asserted by the answer.
KNOWN = """kn AS (
 SELECT l_orderkey AS aid, 'sourced' AS origin, CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR) AS figure FROM lineitem
 UNION ALL SELECT o_orderkey, 'sourced', unnest([CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR), CAST(CAST(round(o_totalprice * 100) AS BIGINT) * 3 AS VARCHAR), '7']) FROM orders WHERE o_orderstatus <> 'P'
 UNION ALL SELECT o_orderkey, 'quoted', unnest(['$9' || format('{:,}', o_orderkey + 1000) || '9', '12%']) FROM orders WHERE o_orderpriority = '5-LOW'
 UNION ALL SELECT o_orderkey, 'asked', unnest(['$' || regexp_extract(CAST((o_orderkey + 1000) / 1000.0::DOUBLE AS VARCHAR), '^[0-9]+\\.[0-9]+'), '$3', format('{:,}', CAST(trunc((o_orderkey + 1000) / 1000.0::DOUBLE * 1000) AS BIGINT)), CAST(CAST(trunc((o_orderkey + 1000) / 1000.0::DOUBLE * 1000) AS BIGINT) AS VARCHAR), '3,000,000', '3000000']) FROM orders WHERE o_orderpriority = '2-HIGH')"""
FIGURES = """fg AS (SELECT aid, unnest([0::BIGINT, 1, 2, 3]) AS pos, unnest(['$' || format('{:,}', total), pct || '%', format('{:,}', total * 3), '$' || format('{:,}', aid + 1000)]) AS figure FROM an),
 st AS (SELECT aid, pos, figure, regexp_replace(figure, '\\D', '', 'g') AS digits FROM fg WHERE length(regexp_replace(figure, '\\D', '', 'g')) > 2)"""


@REG.add(
    "j01_audit_figures",
    f"""WITH {ANSWERS}, {KNOWN}, {FIGURES} SELECT aid, pos, figure FROM st WHERE NOT EXISTS (SELECT 1 FROM kn WHERE kn.aid = st.aid AND contains(regexp_replace(kn.figure, '\\D', '', 'g'), st.digits))""",
)
def j01(v):
    return A.audit_figures(answers(v), known(v))


@REG.add("j02_known_figures", f"WITH {KNOWN} SELECT DISTINCT aid, origin, regexp_replace(figure, '\\D', '', 'g') AS digits FROM kn")
def j02(v):
    return known(v).select("aid", "origin", "digits").distinct()


@REG.add(
    "j03_expand_suffixes",
    """SELECT o_orderkey AS aid, CASE WHEN n < 1000 THEN '' ELSE format('{:,}', n) || '|' END || n || '|' || format('{:,}', m) || '|' || m AS forms FROM (
 SELECT o_orderkey, CAST(trunc(CAST((o_custkey + 1) / 4.0::DOUBLE AS DOUBLE) * 1000) AS BIGINT) AS n, (o_orderkey + 1) * 1000000 AS m FROM orders)""",
)
def j03(v):
    text = F.concat(
        F.lit("about $"), ((C("o_custkey") + 1) / 4).cast("string"), F.lit("k, or $ "),
        (C("o_orderkey") + 1).cast("string"), F.lit(" M; not 5k nor $7 monkeys"),
    )
    return v.orders.select(
        C("o_orderkey").alias("aid"), F.array_join(A.expand_suffixes(text), "|").alias("forms")
    )


def passages(v):
    return v.lines.select(
        C("order_id").alias("aid"),
        F.concat(F.lit("Art. VII §"), C("line_no").cast("string"), F.lit("(a)")).alias("citation"),
        F.concat(F.lit("passage "), (C("player") % 3).cast("string")).alias("text"),
        (C("flag") != "N").alias("is_evidence"),
        C("cap_figure").alias("seq"),
    )


@REG.add(
    "j04_quotes",
    """SELECT aid, citation, text, cited_in_answer, row_number() OVER (PARTITION BY aid ORDER BY cited_in_answer DESC, seq) AS place FROM (
 SELECT l.order_id AS aid, 'Art. VII §' || line_no || '(a)' AS citation, 'passage ' || (player % 3) AS text, min(cap_figure) AS seq, any_value(line_no = month(o_orderdate)) AS cited_in_answer
 FROM f_lines l JOIN orders o ON o.o_orderkey = l.order_id WHERE flag <> 'N' GROUP BY ALL)""",
)
def j04(v):
    return A.quotes(passages(v), answers(v))


@REG.add(
    "j05_figure_links",
    f"""WITH {ANSWERS}, {FIGURES}, rs AS (SELECT DISTINCT order_id AS aid, contract_id AS call, CAST(cap_figure AS VARCHAR) AS digits FROM f_lines
 UNION SELECT o_orderkey, 'order', unnest([CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR), CAST(CAST(round(o_totalprice * 100) AS BIGINT) * 3 AS VARCHAR)]) FROM orders WHERE o_orderstatus <> 'P')
 SELECT st.aid, rs.call, st.pos, st.figure FROM st JOIN rs ON rs.aid = st.aid AND rs.digits = st.digits""",
)
def j05(v):
    return A.figure_links(answers(v), results(v))


def verdicts(v):
    """What a run left behind, one per event."""
    t, val = C("event_type"), C("value")
    return v.events.select(
        C("event_id").alias("aid"),
        t.alias("bait"),
        F.when(val < 3, " ").otherwise(F.concat(F.lit("answer "), t)).alias("text"),
        F.when(val < 60, 0).otherwise(F.floor(val / 60)).cast("bigint").alias("n_citations"),
        ((t == "error") & (val > 20)).alias("refused"),
        F.when((t == "view") & (val > 100), "which one?").alias("clarification"),
        F.when((t == "signup") & (val > 150), "rate limit").alias("over_budget"),
        F.when((t == "click") & (val < 5), 1).otherwise(0).alias("n_unsourced"),
        (val > 200).alias("exhausted"),
        F.when((t == "purchase") & (val < 8), "quota").alias("fallback"),
        F.when(val.between(10, 20), 2).otherwise(0).alias("n_unknown"),
        F.when(val.between(15, 30), 1).otherwise(0).alias("n_undated"),
        t.isin("click", "view").alias("must_call_tool"),
        (t == "error").alias("must_refuse"),
        F.floor(val / 4).cast("bigint").alias("n_tool_calls"),
    )


VERDICTS = """vd AS (SELECT *, n_citations > 0 OR refused OR clarification IS NOT NULL OR over_budget IS NOT NULL AS supported, trim(text) <> '' OR refused OR clarification IS NOT NULL AS answered FROM (
 SELECT event_id AS aid, event_type AS bait, CASE WHEN value < 3 THEN ' ' ELSE 'answer ' || event_type END AS text, CAST(CASE WHEN value < 60 THEN 0 ELSE floor(value / 60) END AS BIGINT) AS n_citations,
 event_type = 'error' AND value > 20 AS refused, CASE WHEN event_type = 'view' AND value > 100 THEN 'which one?' END AS clarification, CASE WHEN event_type = 'signup' AND value > 150 THEN 'rate limit' END AS over_budget,
 CASE WHEN event_type = 'click' AND value < 5 THEN 1 ELSE 0 END AS n_unsourced, value > 200 AS exhausted, CASE WHEN event_type = 'purchase' AND value < 8 THEN 'quota' END AS fallback,
 CASE WHEN value BETWEEN 10 AND 20 THEN 2 ELSE 0 END AS n_unknown, CASE WHEN value BETWEEN 15 AND 30 THEN 1 ELSE 0 END AS n_undated,
 event_type IN ('click', 'view') AS must_call_tool, event_type = 'error' AS must_refuse, CAST(floor(value / 4) AS BIGINT) AS n_tool_calls FROM events))"""


@REG.add(
    "j06_warnings",
    f"""WITH {VERDICTS} SELECT aid, array_to_string(list_filter([CASE WHEN n_unsourced > 0 THEN 'unsourced_figures' END, CASE WHEN answered AND NOT supported THEN 'unsupported' END,
 CASE WHEN exhausted THEN 'exhausted_rounds' END, CASE WHEN fallback IS NOT NULL THEN 'fallback_model' END, CASE WHEN n_unknown > 0 THEN 'unknown_values' END, CASE WHEN n_undated > 0 THEN 'undated_rows' END], lambda x: x IS NOT NULL), '|') AS warnings FROM vd""",
)
def j06(v):
    f = A.verdict_flags(verdicts(v))
    return f.select("aid", A.warnings(f).alias("warnings"))


@REG.add(
    "j07_verdict_flags",
    f"""WITH {VERDICTS} SELECT aid, supported, answered, answered AND supported AND n_unsourced = 0 AS trustworthy,
 CASE WHEN over_budget IS NOT NULL OR NOT answered THEN 'unavailable' WHEN refused THEN 'refused' WHEN clarification IS NOT NULL THEN 'clarification' ELSE 'answered' END AS status FROM vd""",
)
def j07(v):
    return A.verdict_flags(verdicts(v)).select("aid", "supported", "answered", "trustworthy", "status")


def labelled(v):
    """Gold labels and what a reader of the text alone would say."""
    gold = F.array_compact(
        F.array(
            F.when(C("quality") == 1, "rules"), F.when(C("toxic") == 1, "refused"), F.when(C("quality") == 0, "data"),
        )
    )
    raw = F.array(
        F.when(C("n_chars") > 900, " Rules").otherwise("DATA"),
        F.when(C("lang") == "en", "rules").otherwise("weather"),
        F.when(C("n_chars") < 700, "refused").otherwise("data "),
    )
    return v.labels.join(v.documents.select("doc_id", "lang", "n_chars"), "doc_id").select(
        "doc_id", gold.alias("expected"), raw.alias("raw"), F.when(C("n_chars") > 6000, "timeout").alias("error"),
    ).withColumn("predicted", A.clean_labels(C("raw")))


LABELLED = """lb AS (SELECT l.doc_id, list_filter([CASE WHEN quality = 1 THEN 'rules' END, CASE WHEN toxic = 1 THEN 'refused' END, CASE WHEN quality = 0 THEN 'data' END], lambda x: x IS NOT NULL) AS expected,
 list_distinct(list_filter([CASE WHEN n_chars > 900 THEN 'rules' ELSE 'data' END, CASE WHEN lang = 'en' THEN 'rules' END, CASE WHEN n_chars < 700 THEN 'refused' ELSE 'data' END], lambda x: x IS NOT NULL)) AS predicted,
 CASE WHEN n_chars > 6000 THEN 'timeout' END AS error FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"""


@REG.add(
    "j08_multilabel_report",
    f"""WITH {LABELLED} SELECT count(*) AS n, count(error) AS errors, round(count(*) FILTER (error IS NULL AND list_sort(expected) = list_sort(predicted)) / count(*), 6) AS accuracy,
 round(coalesce(count(*) FILTER (list_contains(expected, 'refused') AND list_contains(predicted, 'refused')) / nullif(count(*) FILTER (list_contains(expected, 'refused')), 0), 0), 6) AS refusal_recall FROM lb""",
)
def j08(v):
    return A.multilabel_report(labelled(v))


@REG.add(
    "j08_per_class",
    f"""WITH {LABELLED}, x AS (SELECT *, unnest(list_distinct(list_concat(expected, predicted))) AS label FROM lb)
 SELECT label, count(*) FILTER (list_contains(expected, label)) AS n_expected, count(*) FILTER (list_contains(predicted, label)) AS n_predicted,
 count(*) FILTER (list_contains(expected, label) AND list_contains(predicted, label)) AS n_hit FROM x GROUP BY label""",
)
def j08_classes(v):
    return A.per_class(labelled(v))


@REG.add("j09_clean_labels", f"WITH {LABELLED} SELECT doc_id, array_to_string(list_sort(predicted), '|') AS labels FROM lb")
def j09(v):
    return labelled(v).select("doc_id", F.array_join(F.array_sort("predicted"), "|").alias("labels"))


@REG.add(
    "j10_selection_report",
    """WITH x AS (SELECT CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 END AS c, CASE WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 0 END AS u, o_orderstatus = 'F' AND o_totalprice > 100000 AS r FROM orders)
 SELECT count(*) AS n, count(*) FILTER (r) AS reached, count(*) FILTER (c > 0 AND NOT r) AS mis_selected, count(*) FILTER (u > 0 AND NOT r) AS invented, count(*) FILTER (c = 0 AND u = 0) AS named_nothing,
 round(count(*) FILTER (r) / count(*), 6) AS accuracy FROM x""",
)
def j10(v):
    return A.selection_report(
        v.orders.select(
            F.when(C("o_orderstatus") == "P", 0).otherwise(1).alias("n_citations"),
            F.when(C("o_orderpriority") == "5-LOW", 1).otherwise(0).alias("n_unresolved"),
            ((C("o_orderstatus") == "F") & (C("o_totalprice") > 100000)).alias("reached"),
        )
    )


@REG.add(
    "j11_adversarial_report",
    f"""WITH {VERDICTS}, x AS (SELECT *, n_unsourced > 0 AS fab, must_call_tool AND n_tool_calls = 0 AND NOT refused AS skip, must_call_tool AND NOT supported AND NOT refused AS uns,
 must_refuse AND NOT refused AS mis, must_call_tool AND refused AS ovr FROM vd)
 SELECT bait, count(*) AS n, count(*) FILTER (fab) AS fabricated, count(*) FILTER (ovr) AS over_refused, count(*) FILTER (skip) AS skipped_tools, count(*) FILTER (uns) AS unsupported,
 count(*) FILTER (mis) AS missed_refusal, count(*) FILTER (fab OR skip OR uns OR mis) AS dangerous, count(*) FILTER (NOT (fab OR skip OR uns OR mis) AND NOT ovr) AS passed FROM x GROUP BY ROLLUP (bait)""",
)
def j11(v):
    return A.adversarial_report(A.verdict_flags(verdicts(v)))


def calls(v, events=None):
    events = v.events if events is None else events
    k = F.get_json_object("props", "$.k").cast("bigint")
    m = C("event_id") % 3
    return events.select(
        C("event_id").alias("call_id"), "ts",
        C("event_type").alias("role"),
        F.when(C("event_type") == "error", "free").when(C("event_type") == "view", "small").otherwise("large").alias("model"),
        F.floor("value").cast("bigint").alias("input"),
        k.alias("output"),
        F.when(m == 0, k * 10).otherwise(0).cast("bigint").alias("cache_read"),
        F.when(m == 1, k).otherwise(0).cast("bigint").alias("cache_write"),
    )


CALLS = """cl AS (SELECT event_id, event_type AS role, CASE event_type WHEN 'error' THEN 'free' WHEN 'view' THEN 'small' ELSE 'large' END AS model, CAST(floor(value) AS BIGINT) AS input,
 CAST(props->>'$.k' AS BIGINT) AS output, CASE WHEN event_id % 3 = 0 THEN CAST(props->>'$.k' AS BIGINT) * 10 ELSE 0 END AS cache_read, CASE WHEN event_id % 3 = 1 THEN CAST(props->>'$.k' AS BIGINT) ELSE 0 END AS cache_write FROM events)"""


def prices(v):
    return v.spark.createDataFrame(
        [("small", 1.0, 5.0, 0.1, 1.25), ("large", 3.0, 15.0, 0.3, 3.75)],
        "model string, input_price double, output_price double, cache_read_price double, cache_write_price double",
    )


@REG.add(
    "j12_usage_report",
    f"""WITH {CALLS}, pr(model, a, b, c, d) AS (VALUES ('small', 1.0::DOUBLE, 5.0::DOUBLE, 0.1::DOUBLE, 1.25::DOUBLE), ('large', 3.0, 15.0, 0.3, 3.75))
 SELECT role, count(*) AS calls, CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output, CAST(sum(cache_read) AS BIGINT) AS cache_read, CAST(sum(cache_write) AS BIGINT) AS cache_write,
 round(sum((input * a + output * b + cache_read * c + cache_write * d) / 1000000), 6) AS cost FROM cl LEFT JOIN pr ON pr.model = cl.model GROUP BY ROLLUP (role)""",
)
def j12(v):
    return A.usage_report(calls(v), prices(v))


@REG.add(
    "j13_cache_hit_rate",
    f"""WITH {CALLS} SELECT role, round(coalesce(sum(cache_read) / nullif(sum(cache_read) + sum(cache_write), 0), 0), 6) AS hit_rate FROM cl GROUP BY ROLLUP (role)""",
)
def j13(v):
    return A.cache_hit_rate(calls(v))


@REG.add(
    "j14_spend_admission",
    """SELECT event_id, before, before < 1000 AS admitted FROM (SELECT event_id, CAST(coalesce(sum(CAST(floor(value) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM events)""",
)
def j14(v):
    return O.spend_admission(
        v.events.select("user_id", "event_id", "ts", "value"), ["user_id"], "ts", "event_id",
        F.floor("value").cast("bigint"), 1000,
    ).select("event_id", "before", "admitted")


@REG.add(
    "j15_trace_metrics",
    """SELECT trace_id, count(*) - 1 AS descendants, count(*) AS events, count(*) + 5 AS units, """
    + ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in A.KINDS)
    + " FROM f_spans GROUP BY trace_id",
)
def j15(v):
    return A.trace_metrics(v.spans, 4)


@REG.add(
    "j16_flatten_spans",
    """WITH RECURSIVE t AS (SELECT trace_id, span_id, 1::BIGINT AS depth, [{'a': started_at, 'b': span_id}] AS path FROM f_spans WHERE parent_id IS NULL
 UNION ALL SELECT s.trace_id, s.span_id, t.depth + 1, list_append(t.path, {'a': s.started_at, 'b': s.span_id}) FROM t JOIN f_spans s ON s.trace_id = t.trace_id AND s.parent_id = t.span_id)
 SELECT trace_id, span_id, depth, row_number() OVER (PARTITION BY trace_id ORDER BY path) AS place FROM t""",
)
def j16(v):
    return A.flatten_spans(v.spans)


# -- order-dependent feeds ---------------------------------------------------

LIMIT, WINDOW_S = 3, 6 * 3600


def stream_paths(v, name):
    return scratch.fresh_path(v.spark, f"{name}-out"), scratch.fresh_path(v.spark, f"{name}-checkpoint")


def requests(df):
    return df.select(C("user_id").alias("key"), C("event_id").alias("id"), O.seconds("ts").alias("us"), F.floor("value").cast("bigint").alias("cost"))


RATE = f"""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
 w AS (SELECT user_id, event_id, us, r, [us] AS held, -1::BIGINT AS wait_us FROM e WHERE r = 1
 UNION ALL SELECT e.user_id, e.event_id, e.us, e.r, CASE WHEN len(k.kept) < {LIMIT} THEN list_append(k.kept, e.us) ELSE k.kept END, CASE WHEN len(k.kept) < {LIMIT} THEN -1 ELSE {WINDOW_S}000000 - (e.us - k.kept[1]) END
 FROM w JOIN e ON e.user_id = w.user_id AND e.r = w.r + 1, LATERAL (SELECT list_filter(w.held, lambda h: e.us - h <= {WINDOW_S}000000) AS kept) k)"""


@REG.add("k01_rate_limit", RATE + " SELECT user_id, event_id, wait_us < 0 AS admitted, CASE WHEN wait_us >= 0 THEN wait_us END AS wait_us FROM w")
def k01(v):
    return O.rate_limit(v.events, "user_id", "ts", "event_id", LIMIT, WINDOW_S)


@REG.add("k01_rate_limit_stream", RATE + " SELECT user_id AS key, event_id AS id, wait_us FROM w")
def k01_stream(v):
    out, ckpt = stream_paths(v, "rate")
    events = feeds.read_stream(v.spark, f"{v.path}/events.parquet")
    feeds.run_to_end(feeds.rate_limit_stream(requests(events), LIMIT, WINDOW_S), out, ckpt)
    return v.spark.read.parquet(out)


CAP = 500
ADMIT = f"""WITH RECURSIVE e AS (SELECT user_id, event_id, CAST(floor(value) AS BIGINT) AS c, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
 w AS (SELECT user_id, event_id, r, CASE WHEN c <= {CAP} THEN c ELSE 0 END AS spent, c <= {CAP} AS admitted FROM e WHERE r = 1
 UNION ALL SELECT e.user_id, e.event_id, e.r, CASE WHEN w.spent + e.c <= {CAP} THEN w.spent + e.c ELSE w.spent END, w.spent + e.c <= {CAP} FROM w JOIN e ON e.user_id = w.user_id AND e.r = w.r + 1)"""


@REG.add("k02_capped_admission", ADMIT + " SELECT user_id, event_id, admitted FROM w")
def k02(v):
    items = v.events.select("user_id", "event_id", "ts", F.floor("value").cast("bigint").alias("cost"))
    return O.capped_admission(items, ["user_id"], "ts", "event_id", "cost", CAP)


@REG.add("k02_capped_admission_stream", ADMIT + " SELECT user_id AS key, event_id AS id, admitted FROM w")
def k02_stream(v):
    out, ckpt = stream_paths(v, "capped")
    events = feeds.read_stream(v.spark, f"{v.path}/events.parquet")
    feeds.run_to_end(feeds.capped_admission_stream(requests(events), CAP), out, ckpt)
    return v.spark.read.parquet(out)


@REG.add(
    "k03_progress_stream",
    """SELECT trace_id, span_id, CASE kind WHEN 'generation' THEN 'step' ELSE 'tool' END AS event, CASE WHEN kind = 'retriever' THEN 'reading the provision' ELSE name END AS text
 FROM f_spans WHERE parent_id IS NOT NULL AND kind IN ('generation', 'retriever')""",
)
def k03(v):
    """Spans logged in two parts and followed as a stream over the log."""
    log = scratch.fresh_path(v.spark, "span-log")
    files.append_traces(v.spans.where("kind = 'generation'"), log)
    files.append_traces(v.spans.where("kind <> 'generation'"), log)
    out, ckpt = stream_paths(v, "progress")
    feeds.run_to_end(feeds.progress(files.read_traces(v.spark, log, stream=True)), out, ckpt)
    return v.spark.read.parquet(out)


@REG.add(
    "k04_closing_events",
    f"""WITH {VERDICTS}, c AS (SELECT aid, CASE WHEN over_budget IS NOT NULL THEN 'error' WHEN refused THEN 'refused' WHEN clarification IS NOT NULL THEN 'clarification' ELSE 'answer' END AS event, text, clarification FROM vd)
 SELECT aid, 1::BIGINT AS place, event, CASE event WHEN 'clarification' THEN clarification ELSE text END AS said FROM c UNION ALL SELECT aid, 2, 'done', 'done' FROM c""",
)
def k04(v):
    return A.closing_events(verdicts(v))


@REG.add(
    "k05_usage_stream",
    f"""WITH {CALLS} SELECT role, count(*) AS calls, CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output, CAST(sum(cache_read) AS BIGINT) AS cache_read, CAST(sum(cache_write) AS BIGINT) AS cache_write FROM cl GROUP BY role""",
)
def k05(v):
    root, ckpt = stream_paths(v, "usage")
    events = feeds.read_stream(v.spark, f"{v.path}/events.parquet")
    feeds.totals_to_end(calls(v, events), root, ckpt)
    return snapshots.read(v.spark, root, "totals")
