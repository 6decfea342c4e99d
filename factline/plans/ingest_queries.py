"""Sources, shaping, identity, precedence and overrides."""

from __future__ import annotations

from pyspark.sql import functions as F

from factline.functions import names as N
from factline.functions import text as X
from factline.operators import ingest, shaping
from factline.plans.registry import Registry
from factline.plans.views import cents
from factline.sources import files, scratch
from factline.sources import snapshots as published
from factline.sources.tables import spread

REG = Registry()
C = F.col
SEASON = 1999

# -- derived inputs --------------------------------------------------------


def order_objects(v):
    """Orders as nested JSON objects with references and lists."""
    o = F.struct(
        F.lit("Order").alias("__typename"),
        C("o_orderkey").alias("id"),
        F.struct(F.concat(F.lit("Customer:"), C("o_custkey").cast("string")).alias("__ref")).alias("customer"),
        F.struct(
            C("o_orderstatus").alias("status"),
            F.struct(C("o_orderpriority").alias("label")).alias("priority"),
        ).alias("meta"),
        F.array(
            F.struct(F.concat(F.lit("Day:"), F.dayofmonth("o_orderdate").cast("string")).alias("__ref")),
            F.struct(F.concat(F.lit("Month:"), F.month("o_orderdate").cast("string")).alias("__ref")),
        ).alias("when"),
        F.array(F.year("o_orderdate").cast("string"), F.lit(None).cast("string")).alias("tags"),
    )
    return spread(v.orders).select(F.to_json(o, {"ignoreNullFields": "false"}).alias("obj"))


def page_paths(v):
    return v.pages.select(
        "page_id",
        F.regexp_extract("url", r"https?://([^/]+)", 1).alias("host"),
        F.regexp_extract("url", r"https?://[^/]+(/[a-z]+/\d+)", 1).alias("path"),
        F.length("html").alias("size"),
    )


PATHS = """SELECT page_id, regexp_extract(url, 'https?://([^/]+)', 1) AS host,
 regexp_extract(url, 'https?://[^/]+(/[a-z]+/\\d+)', 1) AS path, length(html) AS size FROM pages"""


def notes(v):
    d = C("o_orderdate").cast("date")
    day = F.date_format(d, "MMM d, yyyy")
    unit = F.when(C("o_totalprice") >= 250000, "M").otherwise("K")
    x = F.when(C("o_totalprice") >= 250000, F.floor(C("o_totalprice") / 100000) / 10).otherwise(
        F.floor(C("o_totalprice") / 100) / 10
    )
    note = F.concat(
        F.when(
            C("o_orderstatus") != "P",
            F.concat(
                F.lit("Signed "), F.month(d).cast("string"), F.lit("-yr/$"), x.cast("string"), unit,
                F.when(C("o_orderpriority") == "1-URGENT", " rookie extension ").otherwise(" contract "),
                day, F.lit("; "),
            ),
        ).otherwise(""),
        F.year(d).cast("string"), F.lit("-01 is a "),
        F.when(C("o_orderpriority") == "5-LOW", "team").otherwise("Player"), F.lit(" option. "),
        F.when(
            C("o_orderpriority") == "2-HIGH",
            F.concat(F.lit("Traded from T"), F.dayofmonth(d).cast("string"), F.lit(" to T"), F.month(d).cast("string"), F.lit(" "), day),
        ).otherwise(F.concat(F.lit("Option exercised "), day)),
    )
    return v.orders.select(C("o_orderkey").alias("order_id"), note.alias("note"))


NOTES = """SELECT o_orderkey AS order_id, CASE WHEN o_orderstatus <> 'P' THEN 'Signed ' || month(d) || '-yr/$' ||
 CASE WHEN o_totalprice >= 250000 THEN floor(o_totalprice / 100000) / 10 ELSE floor(o_totalprice / 100) / 10 END ||
 CASE WHEN o_totalprice >= 250000 THEN 'M' ELSE 'K' END ||
 CASE WHEN o_orderpriority = '1-URGENT' THEN ' rookie extension ' ELSE ' contract ' END || day || '; ' ELSE '' END ||
 year(d) || '-01 is a ' || CASE WHEN o_orderpriority = '5-LOW' THEN 'team' ELSE 'Player' END || ' option. ' ||
 CASE WHEN o_orderpriority = '2-HIGH' THEN 'Traded from T' || day(d) || ' to T' || month(d) || ' ' || day ELSE 'Option exercised ' || day END AS note
 FROM (SELECT *, CAST(o_orderdate AS DATE) AS d, strftime(o_orderdate, '%b %-d, %Y') AS day FROM orders)"""


def decisions(v):
    t = C("p_type")
    text = (
        F.when(t == "ECONOMY", F.concat(F.lit("Player Option — "), C("p_name")))
        .when(t == "STANDARD", F.lit("2026-27 Club Option"))
        .when(t == "LARGE", F.concat(F.lit("Qualifying Offer - "), C("p_brand")))
        .when(t == "PROMO", F.lit("GUARANTEED 2025-26"))
        .when(t == "MEDIUM", F.lit("Extension Eligible"))
        .otherwise(F.lit("Waiver claim"))
    )
    return v.part.select(C("p_partkey").alias("part"), text.alias("decision"))


DECISIONS = """SELECT p_partkey AS part, CASE p_type WHEN 'ECONOMY' THEN 'Player Option — ' || p_name WHEN 'STANDARD' THEN '2026-27 Club Option'
 WHEN 'LARGE' THEN 'Qualifying Offer - ' || p_brand WHEN 'PROMO' THEN 'GUARANTEED 2025-26' WHEN 'MEDIUM' THEN 'Extension Eligible' ELSE 'Waiver claim' END AS decision FROM part"""


def snapshots(v):
    url = C("url")
    form = (
        F.when(F.contains(url, F.lit("#top")), "/cap/_/year/2024")
        .when(url.endswith(".html"), "/cap-hit/")
        .when(F.contains(url, F.lit("?page")), "/cap/?page=2")
        .when(F.contains(url, F.lit("?utm")), "/cap/_/year/2021")
        .when(url.endswith("/"), "/cap/2022/")
        .otherwise("/roster")
    )
    lang = F.regexp_extract(url, r"https?://[^/]+/([a-z]+)/", 1)
    return v.pages.select(
        F.regexp_extract(url, r"https?://([^/]+)", 1).alias("team"),
        form.alias("url"),
        F.concat(F.when(lang == "en", "2024").otherwise("2023"), F.lpad(C("page_id").cast("string"), 12, "0")).alias("ts"),
    )


SNAPSHOTS = """SELECT regexp_extract(url, 'https?://([^/]+)', 1) AS team,
 CASE WHEN contains(url, '#top') THEN '/cap/_/year/2024' WHEN url LIKE '%.html' THEN '/cap-hit/' WHEN contains(url, '?page') THEN '/cap/?page=2'
 WHEN contains(url, '?utm') THEN '/cap/_/year/2021' WHEN url LIKE '%/' THEN '/cap/2022/' ELSE '/roster' END AS url,
 CASE WHEN regexp_extract(url, 'https?://[^/]+/([a-z]+)/', 1) = 'en' THEN '2024' ELSE '2023' END || lpad(page_id::VARCHAR, 12, '0') AS ts FROM pages"""

# -- A: sources and shaping ------------------------------------------------


@REG.add(
    "a01_read_csv",
    "SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name, CAST(s_nationkey AS VARCHAR) AS s_nationkey, 0::BIGINT AS missing_rows FROM supplier",
)
def a01(v):
    """A CSV read back as text beside a file that does not exist."""
    path = scratch.fresh_path(v.spark, "suppliers")
    v.supplier.select("s_suppkey", "s_name", "s_nationkey").write.csv(path, header=True)
    found = files.read_csv_or_empty(v.spark, path, ["s_suppkey", "s_name", "s_nationkey"])
    gone = files.read_csv_or_empty(v.spark, path + "-missing", ["a"]).agg(F.count("*").alias("missing_rows"))
    return found.withColumn("k", F.lit(1)).join(gone.withColumn("k", F.lit(1)), "k").drop("k")


@REG.add(
    "a02_source_dates",
    """SELECT event_type AS source, CAST(CAST(max(ts) AS DATE) AS VARCHAR) AS scraped FROM events WHERE event_type <> 'error' GROUP BY 1""",
)
def a02(v):
    """Manifests written per source, one of them never; read back as dates."""
    kinds = ("signup", "view", "click", "purchase", "error")
    path = scratch.fresh_path(v.spark, "manifests")
    (
        v.events.where("event_type <> 'error'")
        .groupBy("event_type")
        .agg(F.date_format(F.max("ts"), "yyyy-MM-dd'T'HH:mm:ss").alias("scraped_at"))
        .repartition(1, "event_type")
        .write.partitionBy("event_type")
        .json(path)
    )
    return files.source_dates(v.spark, {k: f"{path}/event_type={k}" for k in kinds})


@REG.add(
    "a03_flatten_json",
    """SELECT o_orderkey AS id, CAST(o_custkey AS VARCHAR) AS customer, o_orderstatus AS meta_status, o_orderpriority AS meta_priority_label,
 day(o_orderdate) || '|' || month(o_orderdate) AS "when", year(o_orderdate) || '|' AS tags FROM orders""",
)
def a03(v):
    schema = v.spark.createDataFrame(
        [],
        "__typename string, id bigint, customer struct<__ref: string>, "
        "meta struct<status: string, priority: struct<label: string>>, "
        "`when` array<struct<__ref: string>>, tags array<string>",
    ).schema
    return shaping.flatten_json(order_objects(v), "obj", schema)


@REG.add(
    "a04_dedup_with_sources",
    f"""SELECT path, arg_min(size, page_id) AS size, min(page_id) AS page_id, string_agg(DISTINCT host, '|' ORDER BY host) AS _sources
 FROM ({PATHS}) GROUP BY path""",
)
def a04(v):
    return shaping.dedup_with_sources(page_paths(v), "path", "host", "page_id")


@REG.add(
    "a05_union_all_keys",
    """SELECT o_orderkey AS id, NULL AS event_type, o_orderstatus AS status, NULL::DOUBLE AS value, 'orders' AS _meta FROM orders
 UNION ALL SELECT event_id, event_type, NULL, value, 'events' FROM events""",
)
def a05(v):
    o = v.orders.select(F.lit("orders").alias("_meta"), C("o_orderstatus").alias("status"), C("o_orderkey").alias("id"))
    e = v.events.select(C("event_id").alias("id"), "value", "event_type", F.lit("events").alias("_meta"))
    return shaping.union_all_keys([o, e])


STRIP = "trim(regexp_replace(replace(replace(replace(replace(regexp_replace({x}, '<[^>]+>', ' ', 'g'), '&quot;', '\"'), '&middot;', '·'), '&copy;', '©'), '&amp;', '&'), '\\s+', ' ', 'g'))"


@REG.add(
    "a06_extract_tables",
    f"""WITH t AS (SELECT page_id, a, h FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<article(?: [^>]*)?>(.*?)</article>', 1)) AS a FROM pages),
 LATERAL (SELECT list_transform(regexp_extract_all(a, '(?s)<h1(?: [^>]*)?>(.*?)</h1>', 1), lambda x: {STRIP.format(x='x')}) AS h)
 WHERE contains(lower(array_to_string(h, ' | ')), 'th'))
 SELECT page_id, CAST(i - 1 AS BIGINT) AS row_no, {STRIP.format(x="split_part(r[i], '</p>', 1)")} AS cell FROM (SELECT page_id, string_split_regex(a, '<p(?: [^>]*)?>')[2:] AS r FROM t), LATERAL (SELECT unnest(range(1, len(r) + 1)) AS i)""",
)
def a06(v):
    """Articles whose heading mentions the needle, paragraph by paragraph."""
    rows = shaping.extract_tables(
        v.pages.select("page_id", "html"), "html", ["th"], "article", "h1", "p", None
    )
    return rows.select("page_id", "row_no", C("cells")[0].alias("cell"))


@REG.add("a07_strip_tags", f"SELECT page_id, {STRIP.format(x='html')} AS text FROM pages")
def a07(v):
    return v.pages.select("page_id", X.strip_tags(C("html")).alias("text"))


@REG.add(
    "a08_unpivot_seasons",
    "SELECT team, CAST(season AS VARCHAR) AS season, CAST(sum(cap_figure) AS BIGINT) AS salary FROM f_contract_seasons GROUP BY ALL",
)
def a08(v):
    years = [str(y) for y in range(1994, 2002)]
    grid = v.contract_seasons.groupBy("team").pivot("season", [int(y) for y in years]).sum("cap_figure")
    return shaping.unpivot_seasons(grid, ["team"], years, "salary")


@REG.add(
    "a09_unpivot_nonempty",
    """SELECT team, 'sign and trade' AS category, name AS detail, 'first' AS scope FROM f_teams WHERE balance < 300000
 UNION ALL SELECT team, 'cash', division, 'first' FROM f_teams WHERE conference = 'ASIA' UNION ALL SELECT team, 'aggregated', name, 'second' FROM f_teams WHERE balance > 700000""",
)
def a09(v):
    t = v.teams.select(
        "team",
        F.when(C("balance") < 300_000, C("name")).otherwise("").alias("sign and trade"),
        F.when(C("conference") == "ASIA", C("division")).otherwise("").alias("cash"),
        F.when(C("balance") > 700_000, C("name")).otherwise("").alias("aggregated"),
    )
    first = shaping.unpivot_nonempty(t, ["team"], ["sign and trade", "cash"], "first")
    return first.unionByName(shaping.unpivot_nonempty(t, ["team"], ["aggregated"], "second"))


SIGNED = "Signed\\s+(\\d+)-yr/\\$([\\d.]+)([MK])\\s+([^.]*?)(\\w+\\s+\\d+,\\s+\\d{4})"


@REG.add(
    "a10_extract_notes",
    f"""SELECT order_id, nullif(regexp_extract(note, '{SIGNED}', 5), '') AS signed_date, CAST(nullif(regexp_extract(note, '{SIGNED}', 1), '') AS BIGINT) AS contract_years,
 CAST(trunc(CAST(nullif(regexp_extract(note, '{SIGNED}', 2), '') AS DOUBLE) * CASE regexp_extract(note, '{SIGNED}', 3) WHEN 'M' THEN 1000000 ELSE 1000 END) AS BIGINT) AS contract_value,
 CASE WHEN note LIKE 'Signed%' THEN contains(lower(regexp_extract(note, '{SIGNED}', 4)), 'extension') END AS is_extension,
 regexp_extract(note, '(\\d{{4}}-\\d{{2}}) is a', 1) || ':' || lower(regexp_extract(note, 'is a (team|Player) option', 1)) AS option_seasons,
 nullif(regexp_extract(note, 'Option exercised (\\w+\\s+\\d+,\\s+\\d{{4}})', 1), '') AS option_exercised,
 nullif(regexp_extract(note, 'Traded from (\\w+) to (\\w+) (\\w+\\s+\\d+,\\s+\\d{{4}})', 1), '') AS traded_from,
 nullif(regexp_extract(note, 'Traded from (\\w+) to (\\w+) (\\w+\\s+\\d+,\\s+\\d{{4}})', 3), '') AS traded_date FROM ({NOTES})""",
)
def a10(v):
    return notes(v).select("order_id", *X.note_facts(C("note")))


@REG.add(
    "a11_classify_decision",
    f"""SELECT part, CASE WHEN contains(l, 'option') THEN 'option' WHEN contains(l, 'qualifying offer') THEN 'qualifying_offer' WHEN contains(l, 'guaranteed') THEN 'guarantee'
 WHEN contains(l, 'extension eligible') THEN 'extension_eligible' ELSE 'other' END AS kind,
 CASE WHEN contains(l, 'player option') THEN 'player' WHEN contains(l, 'club option') THEN 'club' END AS holder,
 nullif(regexp_extract(decision, '(\\d{{4}}-\\d{{2}})', 1), '') AS season,
 CASE WHEN contains(decision, '—') THEN trim(split_part(decision, '—', 2)) WHEN contains(decision, ' - ') THEN trim(split_part(decision, ' - ', 2)) END AS note
 FROM (SELECT *, lower(decision) AS l FROM ({DECISIONS}))""",
)
def a11(v):
    return decisions(v).select("part", *X.classify_decision(C("decision")))


@REG.add(
    "a12_pick_snapshot",
    f"""WITH c AS (SELECT *, CASE WHEN contains(url, '/year/2024') OR regexp_matches(url, '/cap/2024/?$') THEN 0 WHEN regexp_matches(url, '/cap/?$') OR regexp_matches(url, '/cap/?\\?') THEN 1
   WHEN contains(url, '/cap-hit') THEN 2 WHEN contains(url, '/year/') OR regexp_matches(url, '/cap/\\d{{4}}/?$') THEN 4 ELSE 3 END AS rank FROM ({SNAPSHOTS})),
 b AS (SELECT * FROM c QUALIFY rank = min(rank) OVER (PARTITION BY team)),
 y AS (SELECT *, abs(CAST(coalesce(nullif(regexp_extract(url, '/(?:year/)?(\\d{{4}})/?$', 1), ''), '9999') AS INTEGER) - 2024) AS d FROM b)
 SELECT team, url, ts, CAST(rank AS BIGINT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY team ORDER BY d, ts) AS r FROM y WHERE rank = 4
  UNION ALL SELECT *, CASE WHEN count(*) FILTER (ts LIKE '2024%') OVER (PARTITION BY team) > 0
    THEN row_number() OVER (PARTITION BY team ORDER BY ts NOT LIKE '2024%', ts) ELSE row_number() OVER (PARTITION BY team ORDER BY ts DESC) END FROM y WHERE rank < 4) WHERE r = 1""",
)
def a12(v):
    return shaping.pick_snapshot(snapshots(v), 2024)


@REG.add(
    "a13_parse_money",
    """SELECT o_orderkey AS order_id, CASE WHEN o_orderpriority = '5-LOW' THEN -1 * CAST(floor(o_totalprice) AS BIGINT) WHEN o_orderpriority = '2-HIGH' THEN NULL
 WHEN o_orderpriority = '1-URGENT' THEN o_custkey ELSE CAST(floor(o_totalprice) AS BIGINT) END AS money FROM orders""",
)
def a13(v):
    p = C("o_orderpriority")
    whole = F.concat(F.lit("$"), F.format_number(F.floor("o_totalprice"), 0))
    text = F.when(p == "5-LOW", F.concat(F.lit("-"), whole)).when(p == "2-HIGH", "none").otherwise(whole)
    key = F.when(p == "1-URGENT", C("o_custkey").cast("string")).otherwise("n/a")
    return v.orders.select(C("o_orderkey").alias("order_id"), X.parse_money(text, key).alias("money"))


@REG.add(
    "a14_as_int",
    """SELECT contract_id, CASE flag WHEN 'A' THEN NULL WHEN 'R' THEN NULL ELSE CAST(trunc(cap_figure / 100.0::DOUBLE) AS BIGINT) END AS value FROM f_lines""",
)
def a14(v):
    text = F.when(C("flag") == "A", "").when(C("flag") == "R", "n/a").otherwise((C("cap_figure") / 100).cast("string"))
    return v.lines.select("contract_id", X.as_int(text).alias("value"))


@REG.add(
    "a15_parse_date_any",
    """SELECT o_orderkey AS order_id, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS parsed FROM orders""",
)
def a15(v):
    d, p = C("o_orderdate"), C("o_orderpriority")
    text = (
        F.when(p == "1-URGENT", F.date_format(d, "yyyy-MM-dd"))
        .when(p == "2-HIGH", F.date_format(d, "MMMM d, yyyy"))
        .when(p == "5-LOW", "sometime soon")
        .otherwise(F.concat(F.lit(" "), F.date_format(d, "M/d/yyyy")))
    )
    return v.orders.select(C("o_orderkey").alias("order_id"), X.parse_date_any(text).alias("parsed"))


@REG.add("a16_publish", "SELECT * REPLACE (CAST(c_nationkey AS BIGINT) AS c_nationkey) FROM customer")
def a16(v):
    """A snapshot written in full and committed by its manifest, and read back through that."""
    root = scratch.fresh_path(v.spark, "snapshot")
    published.publish({"customer": v.customer, "nation": v.nation}, root)
    return published.read(v.spark, root, "customer")


COUNTED = ("orders", "customer", "supplier", "part", "events")


@REG.add(
    "a17_build_meta",
    """SELECT 'built_at' AS key, '"' || max(CAST(o_orderdate AS DATE)) || '"' AS value FROM orders UNION ALL SELECT 'season', '"2000-2001"'
 UNION ALL SELECT 'source_dates', '{' || string_agg('"' || k || '":"' || d || '"', ',' ORDER BY k) || '}' FROM (SELECT event_type AS k, max(CAST(ts AS DATE)) AS d FROM events GROUP BY 1)
 UNION ALL SELECT 'counts', '{' || string_agg('"' || k || '":' || n, ',' ORDER BY k) || '}' FROM ("""
    + " UNION ALL ".join(f"SELECT '{t}' AS k, count(*) AS n FROM {t}" for t in sorted(COUNTED))
    + ")",
)
def a17(v):
    built = v.orders.agg(F.max(C("o_orderdate").cast("date")).cast("string").alias("built_at"))
    dates = v.events.groupBy(C("event_type").alias("source")).agg(F.max(C("ts").cast("date")).cast("string").alias("scraped"))
    counts = ingest.ingest_counts({t: v.table(t) for t in COUNTED})
    return ingest.build_meta(built, "2000-2001", dates, counts)


@REG.add(
    "a18_verify_pinned",
    """SELECT CAST(doc_id AS VARCHAR) AS path, CAST(octet_length(encode(text)) AS BIGINT) AS found_size,
 CASE WHEN lang = 'de' THEN 'not_pinned' WHEN n_chars > 3000 THEN 'size_mismatch' WHEN lang = 'fr' THEN 'hash_mismatch' END AS reason FROM documents""",
)
def a18(v):
    content = C("text").cast("binary")
    path = C("doc_id").cast("string").alias("path")
    found = v.documents.select(path, content.alias("content"))
    size = F.octet_length(content).cast("bigint")
    manifest = v.documents.where("lang <> 'de'").select(
        path,
        F.when(C("n_chars") > 3000, size + 1).otherwise(size).alias("size"),
        F.when(C("lang") == "fr", F.sha2(F.lit("stale"), 256)).otherwise(F.sha2(content, 256)).alias("sha256"),
    )
    return files.verify_pinned(found, manifest)


@REG.add(
    "a19_trace_log",
    """SELECT kind, count(*) AS n, count(parent_id) AS n_children FROM f_spans GROUP BY kind""",
)
def a19(v):
    """Spans appended to a JSON-lines log in two writes, then scanned."""
    path = scratch.fresh_path(v.spark, "traces")
    spans = v.spans
    files.append_traces(spans.where("kind <> 'generation'"), path)
    files.append_traces(spans.where("kind = 'generation'"), path)
    return files.read_traces(v.spark, path).groupBy("kind").agg(
        F.count("*").alias("n"), F.count("parent_id").alias("n_children")
    )


@REG.add(
    "a20_select_by_header",
    """SELECT contract_id, contract_type AS type, CAST(cap_figure AS VARCHAR) AS cap_hit, NULL::VARCHAR AS trade_bonus, flag AS pos FROM f_contract_seasons""",
)
def a20(v):
    cells = F.array(C("cap_figure").cast("string"), C("flag"), F.lit(""), C("contract_type"))
    return shaping.select_by_header(
        v.contract_seasons.select("contract_id", cells.alias("cells")),
        ["Cap Hit (2026)", "Pos.", "Age", "Type of deal"],
        {"type": ["type"], "cap_hit": ["cap hit"], "trade_bonus": ["trade bonus"], "pos": ["position", "pos"]},
        "cells",
    )


@REG.add(
    "a21_unpivot_slots",
    """WITH r AS (SELECT season, team, p.display_name, p.kind, row_number() OVER (PARTITION BY season, team ORDER BY cap_figure DESC, contract_id) - 1 AS r FROM f_contract_seasons c JOIN f_players p ON p.player = c.player)
 SELECT season || '-' || substr(CAST(season + 1 AS VARCHAR), 3, 2) AS season, 'All-NBA' AS award, team, r // 5 + 1 AS place, CAST(r % 5 + 1 AS VARCHAR) AS slot, display_name AS player_name,
 CASE kind WHEN 'SMALL' THEN 'G' WHEN 'LARGE' THEN 'C' END AS position FROM r WHERE season >= 1997""",
)
def a21(v):
    """All contracts of a team and season, five to a row as the source prints them."""
    from pyspark.sql import Window as W

    w = W.partitionBy("season", "team").orderBy(F.desc("cap_figure"), "contract_id")
    rows = (
        v.contract_seasons.select("season", "team", "player", "cap_figure", "contract_id")
        .join(v.players.select("player", "display_name", "kind"), "player")
        .withColumn("r", F.row_number().over(w) - 1)
    )
    tagged = F.concat(
        C("display_name"), F.when(C("kind") == "SMALL", " G").when(C("kind") == "LARGE", " C").otherwise("")
    )
    wide = (
        rows.withColumn("slot", C("r") % 5 + 1)
        .groupBy(
            F.concat(C("season").cast("string"), F.lit("-"), F.substr((C("season") + 1).cast("string"), F.lit(3))).alias("season"),
            F.lit("All-NBA").alias("award"),
            "team",
            (F.floor(C("r") / 5) + 1).alias("place"),
        )
        .pivot("slot", [1, 2, 3, 4, 5])
        .agg(F.first(tagged))
    )
    return shaping.unpivot_slots(wide, ["season", "award", "team", "place"], 1997)


@REG.add(
    "a22_service_years",
    """SELECT p_partkey AS part, CASE WHEN p_size < 4 THEN 0 WHEN p_size < 45 THEN p_size // 4 END::BIGINT AS years FROM part""",
)
def a22(v):
    size = C("p_size")
    text = (
        F.when(size < 4, F.when(C("p_type") == "SMALL", "r").otherwise("R"))
        .when(size < 45, F.floor(size / 4).cast("string"))
        .otherwise("—")
    )
    return v.part.select(C("p_partkey").alias("part"), X.parse_service_years(text).alias("years"))


@REG.add(
    "a23_repair_name",
    """SELECT p_partkey AS part, CASE WHEN p_type = 'PROMO' THEN p_brand ELSE p_name END AS name FROM part""",
)
def a23(v):
    last = F.element_at(F.split("p_name", " "), -1)
    cell = (
        F.when(C("p_type") == "ECONOMY", F.concat(F.lit('<td>X <a href="/p">'), C("p_name"), F.lit("</a></td>")))
        .when(C("p_type") == "PROMO", F.concat(F.lit("<b>"), C("p_brand"), F.lit("</b>")))
        .otherwise(F.concat(last, F.lit(" "), C("p_name")))
    )
    return v.part.select(C("p_partkey").alias("part"), X.repair_name(cell).alias("name"))


# -- B: identity, precedence, overrides -------------------------------------

NORM = "trim(regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(replace(replace(strip_accents({x}), '''', ''), '.', ''), '[^\\x00-\\x7F]', '', 'g'), '(?i)\\b(jr|sr|ii|iii|iv|v)\\b\\.?', ' ', 'g')), '[^a-z ]', ' ', 'g'), ' +', ' ', 'g'))"


@REG.add("b01_normalise_name", f"SELECT doc_id, {NORM.format(x='text')} AS key FROM documents")
def b01(v):
    return v.documents.select("doc_id", N.normalise_name(C("text")).alias("key"))


EXTRA = {"hot ring": "warm ring", "small plate": "saucer"}


@REG.add(
    "b02_apply_aliases",
    "SELECT p_partkey AS part, CASE p_name WHEN 'hot ring' THEN 'warm ring' WHEN 'small plate' THEN 'saucer' ELSE p_name END AS key FROM part",
)
def b02(v):
    df = v.part.select(C("p_partkey").alias("part"), N.normalise_name(C("p_name")).alias("key"))
    return N.apply_aliases(df, "key", N.alias_rows(v.spark, EXTRA))


NICKS = list(N.NICKNAMES)
NICK_SQL = "[" + ", ".join(f"'{n}'" for n in NICKS) + "]"
CODE_SQL = "[" + ", ".join(f"'{c}'" for c in N.NICKNAMES.values()) + "]"


@REG.add(
    "b03_team_codes",
    f"""SELECT c_custkey AS customer, {CODE_SQL}[c_nationkey + 1] AS by_slug,
 CASE WHEN c_mktsegment = 'BUILDING' THEN 'BRK' WHEN c_mktsegment = 'MACHINERY' OR {NICK_SQL}[c_nationkey + 1] = '76ers' THEN NULL ELSE {CODE_SQL}[c_nationkey + 1] END AS by_display,
 CASE WHEN c_mktsegment = 'BUILDING' THEN 'BRK' ELSE {CODE_SQL}[c_nationkey + 1] END AS by_code FROM customer""",
)
def b03(v):
    nick = F.get(F.array(*[F.lit(n) for n in NICKS]), C("c_nationkey"))
    code = F.get(F.array(*[F.lit(c) for c in N.NICKNAMES.values()]), C("c_nationkey"))
    seg = C("c_mktsegment")
    display = (
        F.when(seg == "BUILDING", F.concat(F.lit("Brooklyn "), F.initcap(nick), F.lit(" BKN")))
        .when(seg == "MACHINERY", F.lit("No Such Club"))
        # Digits are not letters: a nickname written with them is not found this way.
        .otherwise(F.concat(F.initcap(seg), F.lit(" "), F.initcap(nick), F.lit(" Inc.")))
    )
    return v.customer.select(
        C("c_custkey").alias("customer"),
        N.from_slug(F.concat(F.lower(seg), F.lit("_"), nick)).alias("by_slug"),
        N.from_display(display).alias("by_display"),
        N.canonical_code(F.when(seg == "BUILDING", " bkn ").otherwise(F.lower(code))).alias("by_code"),
    )


def observations(v):
    """Three sources naming the same things, with ids from two id spaces."""
    name, key = C("p_name"), C("p_partkey")
    rows = F.array(
        F.when(
            C("p_size") > 10,
            F.struct(
                F.upper(name).alias("name"), F.lit("roster").alias("source"), key.alias("seq"),
                F.when(C("p_size") > 20, key).alias("id_a"), F.lit(None).cast("string").alias("id_b"),
            ),
        ),
        F.struct(
            F.replace(name, F.lit("o"), F.lit("ó")).alias("name"), F.lit("payroll").alias("source"),
            (key + 1_000_000_000).alias("seq"), F.lit(None).cast("bigint").alias("id_a"),
            F.when((C("p_type") == "SMALL") & (C("p_size") > 40), C("p_brand")).alias("id_b"),
        ),
        F.when(
            C("p_size") == 50,
            F.struct(
                F.concat(F.lit("New "), C("p_brand"), F.lit(" Jr.")).alias("name"), F.lit("awards").alias("source"),
                (key + 2_000_000_000).alias("seq"), F.lit(None).cast("bigint").alias("id_a"),
                F.lit(None).cast("string").alias("id_b"),
            ),
        ),
    )
    return (
        v.part.select(F.explode(rows).alias("o")).where("o is not null").select("o.*")
        .withColumn("key", N.normalise_name(C("name")))
    )


OBS = """SELECT upper(p_name) AS name, p_name AS key, 'roster' AS source, p_partkey AS seq, CASE WHEN p_size > 20 THEN p_partkey END AS id_a, NULL AS id_b FROM part WHERE p_size > 10
 UNION ALL SELECT replace(p_name, 'o', 'ó'), p_name, 'payroll', p_partkey + 1000000000, NULL, CASE WHEN p_type = 'SMALL' AND p_size > 40 THEN p_brand END FROM part
 UNION ALL SELECT 'New ' || p_brand || ' Jr.', 'new brand', 'awards', p_partkey + 2000000000, NULL, NULL FROM part WHERE p_size = 50"""
IDS = f"""SELECT key, arg_min(name, seq) AS display_name, arg_min(id_a, seq) FILTER (id_a IS NOT NULL) AS id_a, arg_min(id_b, seq) FILTER (id_b IS NOT NULL) AS id_b,
 string_agg(DISTINCT source, '|' ORDER BY source) AS sources FROM ({OBS}) GROUP BY key"""


@REG.add("b04_resolve_identities", IDS)
def b04(v):
    return ingest.resolve_identities(observations(v))


@REG.add("b05_unresolved", f"SELECT key, sources FROM ({IDS}) WHERE id_a IS NULL AND id_b IS NULL")
def b05(v):
    return ingest.unresolved(ingest.resolve_identities(observations(v)))


@REG.add(
    "b06_resolution_summary",
    f"""SELECT count(*) AS identities, count(id_a) AS with_a, count(id_b) AS with_b, count(*) FILTER (id_a IS NOT NULL AND id_b IS NOT NULL) AS cross_linked,
 count(*) FILTER (id_a IS NULL AND id_b IS NULL) AS unresolved FROM ({IDS})""",
)
def b06(v):
    return ingest.resolution_summary(ingest.resolve_identities(observations(v)))


# Field -> sources, best first.
PRECEDENCE = {"total": ["ledger", "rounded"], "priority": ["crm"]}


def precedence(v):
    return v.spark.createDataFrame(
        [(f, s, i) for f, ss in PRECEDENCE.items() for i, s in enumerate(ss)],
        "field string, source string, rank int",
    )


def candidates(v):
    total = cents(C("o_totalprice"))

    def cand(field, source, value, arrival):
        return F.struct(
            F.lit(field).alias("field"), F.lit(source).alias("source"),
            value.cast("string").alias("value"), F.lit(arrival).alias("arrival"),
        )

    rows = F.array(
        cand("total", "statement", total, 0),
        cand("total", "rounded", F.when(C("o_orderstatus") == "F", F.floor(total / 100) * 100).otherwise(total), 1),
        cand("total", "ledger", F.when(C("o_orderpriority") != "1-URGENT", total), 2),
        cand("priority", "mail", F.when(C("o_orderstatus") == "P", "9-OTHER").otherwise(C("o_orderpriority")), 0),
        cand("priority", "crm", F.when(C("o_orderpriority") != "5-LOW", C("o_orderpriority")).otherwise(""), 1),
    )
    return v.orders.select(C("o_orderkey").alias("subject"), F.explode(rows).alias("c")).select("subject", "c.*")


CANDS = """(SELECT *, CASE field || '/' || source WHEN 'total/ledger' THEN 0 WHEN 'total/rounded' THEN 1 WHEN 'priority/crm' THEN 0 ELSE 1000000 + arrival END AS ord FROM (
 SELECT o_orderkey AS subject, 'total' AS field, 'statement' AS source, CAST(t AS VARCHAR) AS value, 0 AS arrival FROM o
 UNION ALL SELECT o_orderkey, 'total', 'rounded', CAST(CASE WHEN o_orderstatus = 'F' THEN t // 100 * 100 ELSE t END AS VARCHAR), 1 FROM o
 UNION ALL SELECT o_orderkey, 'total', 'ledger', CAST(CASE WHEN o_orderpriority <> '1-URGENT' THEN t END AS VARCHAR), 2 FROM o
 UNION ALL SELECT o_orderkey, 'priority', 'mail', CASE WHEN o_orderstatus = 'P' THEN '9-OTHER' ELSE o_orderpriority END, 0 FROM o
 UNION ALL SELECT o_orderkey, 'priority', 'crm', CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END, 1 FROM o) WHERE value IS NOT NULL)"""
CANDS_WITH = "WITH o AS (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS t FROM orders), c AS " + CANDS


@REG.add(
    "b07_resolve_field",
    CANDS_WITH + " SELECT field, subject, arg_min(source, ord) AS chosen, arg_min(value, ord) AS chosen_value FROM c GROUP BY ALL",
)
def b07(v):
    return ingest.resolve_field(candidates(v), precedence(v))


@REG.add(
    "b08_disagreements",
    CANDS_WITH
    + """ SELECT field, subject, arg_min(source, ord) AS chosen, arg_min(value, ord) AS chosen_value,
 '{' || array_to_string(list('"' || source || '":"' || value || '"' ORDER BY ord)[2:], ',') || '}' AS others
 FROM c GROUP BY ALL HAVING count(DISTINCT value) > 1""",
)
def b08(v):
    return ingest.disagreements(candidates(v), precedence(v))


@REG.add(
    "b09_reconcile_summary",
    CANDS_WITH
    + """, s AS (SELECT field, subject, count(DISTINCT value) > 1 AS d FROM c GROUP BY ALL)
 SELECT field, count(*) FILTER (NOT d) AS agreements, count(*) FILTER (d) AS disagreements FROM s GROUP BY field
 UNION ALL SELECT NULL, count(*) FILTER (NOT d), count(*) FILTER (d) FROM s""",
)
def b09(v):
    return ingest.reconcile_summary(candidates(v), precedence(v))


def listed(v):
    """What the first source lists: contract years, the first contract per player and team."""
    contracts = v.contracts("player", "team")
    years = v.years_of(contracts).where("disc > 0").select("player", "team", "season", "contract_id", C("cap_figure").alias("salary"))
    return ingest.dedup_first(years, ["player", "team", "season"], ["contract_id"]).drop("contract_id")


def payroll(v):
    now = v.contracts("player", "team").where((C("season") == SEASON) & (C("tax") > 0)).select(
        "player", "team", "contract_id",
        (C("cap_figure") + F.when(C("disc") >= 5, 1).otherwise(0)).alias("amount"),
    )
    return ingest.dedup_first(now, ["player", "team"], ["contract_id"]).drop("contract_id")


MERGED = f"""WITH y AS (SELECT player, team, season, arg_min(cap_figure, contract_id) AS salary FROM f_years WHERE disc > 0 GROUP BY ALL),
 a AS (SELECT *, max(season = {SEASON} AND salary <> 0) OVER (PARTITION BY player, team) AS listed_now FROM y),
 k AS (SELECT player, team, max(season = {SEASON}) AS has_now FROM y GROUP BY ALL),
 b AS (SELECT player, team, arg_min(cap_figure + CASE WHEN disc >= 5 THEN 1 ELSE 0 END, contract_id) AS amount FROM f_contract_seasons WHERE season = {SEASON} AND tax > 0 GROUP BY ALL),
 m AS (
 SELECT a.player, a.team, a.season, CASE WHEN a.season = {SEASON} AND b.amount IS NOT NULL THEN b.amount ELSE a.salary END AS salary, a.salary AS listed,
  CASE WHEN b.amount IS NULL AND a.listed_now THEN 'dropped'
   WHEN a.season <> {SEASON} OR b.amount IS NULL THEN 'kept' WHEN a.salary = b.amount THEN 'confirmed' ELSE 'overruled' END AS outcome
 FROM a LEFT JOIN b ON b.player = a.player AND b.team = a.team
 UNION ALL SELECT b.player, b.team, {SEASON}, b.amount, NULL, CASE WHEN k.player IS NULL THEN 'payroll_only' ELSE 'added' END
 FROM b LEFT JOIN k ON k.player = b.player AND k.team = b.team WHERE NOT coalesce(k.has_now, false))"""


@REG.add("b10_merge_payroll", MERGED + " SELECT * FROM m")
def b10(v):
    return ingest.merge_payroll(listed(v), payroll(v), SEASON)


@REG.add(
    "b11_dedup_first",
    "SELECT order_id, line_no, min(contract_id) AS contract_id, arg_min(cap_figure, contract_id) AS cap_figure FROM f_lines GROUP BY ALL",
)
def b11(v):
    rows = v.lines.select("order_id", "line_no", "contract_id", "cap_figure")
    return ingest.dedup_first(rows, ["order_id", "line_no"], ["contract_id"])


@REG.add(
    "b12_upsert_last",
    """SELECT o_custkey AS customer, order_id, total FROM (SELECT o_custkey, o_orderkey AS order_id, CAST(round(o_totalprice * 100) AS BIGINT) AS total,
 row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1""",
)
def b12(v):
    rows = v.orders.select(
        C("o_custkey").alias("customer"), C("o_orderkey").alias("order_id"),
        cents(C("o_totalprice")).alias("total"), C("o_orderdate").alias("written"),
    )
    return ingest.upsert_last(rows, ["customer"], ["written", "order_id"]).drop("written")


@REG.add(
    "b13_surrogate_id",
    "SELECT contract_id, row_number() OVER (ORDER BY order_id, contract_id) AS id FROM f_lines",
)
def b13(v):
    return ingest.with_surrogate_id(v.lines.select("order_id", "contract_id"), ["order_id", "contract_id"]).drop("order_id")


@REG.add(
    "b14_null_missing_fk",
    """SELECT o_orderkey AS order_id, c_custkey AS customer FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey""",
)
def b14(v):
    o = v.orders.select(C("o_orderkey").alias("order_id"), C("o_custkey").alias("customer"))
    return ingest.null_missing_fk(o, "customer", v.customer.where("c_acctbal > 0"), "c_custkey")


def overrides(v):
    """Assertions on one year's pick per team, some malformed, some about no pick at all."""
    b = C("balance")
    return v.teams.where(b < 500_000).select(
        (C("team") + 2).alias("line"),
        F.lit(2029).cast("bigint").alias("year"),
        (C("team") % 2 + 1).alias("round"),
        C("team").alias("original_team"),
        C("team").alias("owner"),
        F.when(b < 0, "revoke").otherwise("forfeit").alias("action"),
        F.when(b > 400_000, " ").otherwise("https://example.org/ruling").alias("citation_url"),
        F.concat(F.lit("ruling on "), C("name")).alias("note"),
    )


OVERRIDES = """SELECT team + 2 AS line, 2029 AS year, team % 2 + 1 AS round, team AS original_team, team AS owner, CASE WHEN balance < 0 THEN 'revoke' ELSE 'forfeit' END AS action,
 CASE WHEN balance > 400000 THEN ' ' ELSE 'https://example.org/ruling' END AS citation_url, 'ruling on ' || name AS note FROM f_teams WHERE balance < 500000"""
GOOD = f"SELECT * FROM ({OVERRIDES}) WHERE trim(citation_url) <> '' AND action = 'forfeit'"


@REG.add(
    "b15_validate_overrides",
    f"""SELECT line, CASE WHEN trim(citation_url) = '' THEN 'no_citation' ELSE 'unsupported_action' END AS error FROM ({OVERRIDES})
 WHERE trim(citation_url) = '' OR action <> 'forfeit'""",
)
def b15(v):
    return ingest.override_errors(overrides(v)).select("line", "error")


def good_overrides(v):
    o = overrides(v)
    return o.join(ingest.override_errors(o).select("line"), "line", "left_anti")


def picks_with_text(v):
    text = F.when(C("protected_to") > 0, F.concat(F.lit("protected 1-"), C("protected_to").cast("string")))
    return v.picks.withColumn("protection_text", text)


@REG.add(
    "b16_apply_overrides",
    f"""SELECT p.original_team, p.year, p.round, p.owner, p.forfeited OR o.line IS NOT NULL AS forfeited,
 nullif(concat_ws(' | ', CASE WHEN p.protected_to > 0 THEN 'protected 1-' || p.protected_to END, 'OVERRIDE forfeit: ' || o.note || ' (' || o.citation_url || ')'), '') AS protection_text
 FROM f_picks p LEFT JOIN ({GOOD}) o ON o.year = p.year AND o.round = p.round AND o.original_team = p.original_team AND o.owner = p.owner""",
)
def b16(v):
    return ingest.apply_overrides(picks_with_text(v), good_overrides(v)).select(
        "original_team", "year", "round", "owner", "forfeited", "protection_text"
    )


@REG.add(
    "b17_unmatched_overrides",
    f"""SELECT o.line, o.original_team FROM ({GOOD}) o WHERE NOT EXISTS (SELECT 1 FROM f_picks p WHERE p.year = o.year AND p.round = o.round AND p.original_team = o.original_team AND p.owner = o.owner)""",
)
def b17(v):
    return ingest.unmatched_overrides(v.picks, good_overrides(v)).select("line", "original_team")


@REG.add(
    "b18_expect_none",
    """SELECT team, season, apron_salary, ceiling_amount, 'no team above its own hard cap' AS invariant FROM f_positions WHERE apron_salary > ceiling_amount""",
)
def b18(v):
    over = v.positions.where("apron_salary > ceiling_amount").select("team", "season", "apron_salary", "ceiling_amount")
    return ingest.expect_none(over, "no team above its own hard cap")


@REG.add(
    "b19_expect_logged",
    MERGED
    + f""" SELECT player, team, 'not_logged' AS problem FROM m WHERE season = {SEASON} AND outcome = 'dropped' AND salary > 9000000
 UNION ALL SELECT player, team, 'still_present' FROM (SELECT DISTINCT player, team FROM m WHERE season = {SEASON} AND outcome = 'dropped') d
 WHERE EXISTS (SELECT 1 FROM m k WHERE k.player = d.player AND k.team = d.team AND k.outcome = 'confirmed')""",
)
def b19(v):
    """A log that leaves out the largest figures, so that the check has something to find."""
    # Only this season's outcomes are looked at: what is confirmed is of this season too.
    merged = scratch.written(ingest.merge_payroll(listed(v), payroll(v), SEASON).where(C("season") == SEASON), "merged")
    keys = ["player", "team"]
    dropped = merged.where((C("season") == SEASON) & (C("outcome") == "dropped")).select(*keys)
    log = ingest.payroll_log(merged, SEASON).where("outcome = 'dropped' and other <= 9000000")
    return ingest.expect_logged(dropped, log, merged.where("outcome = 'confirmed'"), keys)


@REG.add(
    "b20_ingest_counts",
    " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in (*COUNTED, "lineitem", "documents", "pages")),
)
def b20(v):
    return ingest.ingest_counts({t: v.table(t) for t in (*COUNTED, "lineitem", "documents", "pages")})
