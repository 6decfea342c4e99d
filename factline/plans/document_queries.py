"""Outlines, passages, definitions and cross-references."""

from __future__ import annotations

from pyspark.sql import functions as F

from factline.functions import text as X
from factline.operators import documents as D
from factline.operators import matching
from factline.plans.registry import Registry

REG = Registry()
C = F.col


@REG.add("h01_squash", "SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM documents")
def h01(v):
    return v.documents.select("doc_id", X.squash(C("text")).alias("text"))


@REG.add("h02_page_starts", "SELECT doc_id, idx, start FROM f_units")
def h02(v):
    return D.page_starts(v.doc_lines).select("doc_id", "idx", "start")


@REG.add(
    "h03_page_for_offset",
    """SELECT o.doc_id, o.at AS "offset", p.idx + 1 AS page FROM (SELECT doc_id, unnest(range(0::BIGINT, CAST(length(text) AS BIGINT) + 1, 250)) AS at FROM f_docs) o
 ASOF JOIN f_units p ON p.doc_id = o.doc_id AND o.at >= p.start""",
)
def h03(v):
    offsets = v.of("docs").select(
        "doc_id", F.explode(F.sequence(F.lit(0), F.length("text"), F.lit(250))).alias("offset")
    ).withColumn("offset", C("offset").cast("bigint"))
    return D.page_for_offset(D.page_starts(v.doc_lines), offsets)


@REG.add(
    "h04_locate_units",
    """WITH n AS (SELECT u.doc_id, u.idx, u.start, substr(lower(d.text), u.start + 1) AS t, CASE WHEN u.level = 4 THEN 'zq ' ELSE '' END || trim(regexp_replace(lower(u.line), '\\s+', ' ', 'g')) AS needle
 FROM f_units u JOIN f_docs d ON d.doc_id = u.doc_id),
 m AS (SELECT *, CASE WHEN contains(t, needle) THEN length(needle) ELSE coalesce(list_max(list_filter(range(40, length(needle)), lambda k: contains(t, left(needle, k)))), 0) END AS matched FROM n)
 SELECT doc_id, idx, CASE WHEN matched = 0 AND needle <> '' THEN -1 ELSE instr(t, left(needle, matched)) - 1 + start END AS start, matched FROM m""",
)
def h04(v):
    """Headings found from their own page on; one in three is worded as the text is not."""
    title = F.when(C("level") == 4, F.concat(F.lit("Zq  "), C("line"))).otherwise(C("line"))
    heads = v.of("units").select("doc_id", "idx", title.alias("title"), C("start").alias("page_start"))
    return D.locate_units(v.of("docs"), heads)


@REG.add("h05_unit_spans", "SELECT doc_id, idx, level, start, own_end, subtree_end FROM f_outline")
def h05(v):
    return D.unit_spans(v.of("units"))


@REG.add(
    "h06_number_units",
    "SELECT doc_id, idx, article, section, all_markers AS markers FROM f_units",
)
def h06(v):
    return D.number_units(v.of("units"))


@REG.add("h07_citation", "SELECT doc_id, idx, citation FROM f_units")
def h07(v):
    return v.of("units").select(
        "doc_id", "idx", D.citation(C("article"), C("section"), C("markers"), C("title")).alias("citation")
    )


@REG.add("h08_by_citation", "SELECT doc_id, citation, idx, start FROM f_by_citation")
def h08(v):
    return D.by_citation(v.of("units").select("doc_id", "citation", "idx", "start"))


@REG.add("h09_resolve_citations", "SELECT doc_id, citation, resolved, dropped FROM f_resolved")
def h09(v):
    v.keep("units")
    refs = D.extract_refs(v.of("units").withColumn("body", C("ref_body"))).select("doc_id", C("wanted").alias("citation"))
    return D.resolve_citations(refs, v.of("units"))


@REG.add(
    "h10_unit_text",
    """SELECT o.doc_id, o.idx, trim(substr(d.text, o.start + 1, o.subtree_end - o.start), ' ' || chr(10)) AS text FROM f_outline o JOIN f_docs d ON d.doc_id = o.doc_id""",
)
def h10(v):
    spans = v.of("outlined").select("doc_id", "idx", C("start").alias("from"), C("subtree_end").alias("to"))
    return D.slice_texts(v.of("docs"), spans).select("doc_id", "idx", "text")


@REG.add(
    "h11_chunk",
    """SELECT doc_id, idx, citation, start, "end", preamble, oversized FROM f_chunks""",
)
def h11(v):
    return v.of("chunks").select("doc_id", "idx", "citation", "start", "end", "preamble", "oversized")


@REG.add(
    "h12_heading_path",
    """SELECT u.doc_id, u.idx, coalesce((SELECT string_agg(a.title, ' > ' ORDER BY a.idx) || ' > ' FROM f_outline a WHERE a.doc_id = u.doc_id AND a.start <= u.start AND a.subtree_end >= u.subtree_end AND a.level < u.level), '') || u.title AS path
 FROM f_outline u""",
)
def h12(v):
    return v.of("outlined").select("doc_id", "idx", D.heading_path().alias("path"))


@REG.add(
    "h13_ordinal",
    """SELECT doc_id, idx, ordinal, citation || CASE WHEN ordinal = 1 THEN '' ELSE ' (passage ' || ordinal || ')' END AS label FROM f_chunks""",
)
def h13(v):
    return v.of("chunks").select("doc_id", "idx", "ordinal", "label")


@REG.add(
    "h14_definitions",
    "SELECT doc_id, term, idx, citation, array_to_string(aliases, '|') AS aliases FROM f_definitions",
)
def h14(v):
    return v.definitions.withColumn("aliases", F.array_join("aliases", "|"))


@REG.add("h15_definition_names", "SELECT * FROM f_definition_names")
def h15(v):
    return v.definition_names.select("doc_id", "name", "term")


TERMS = """nn AS (SELECT doc_id, name, term, length(name) AS n FROM f_definition_names WHERE name <> ''),
 wp AS (SELECT doc_id, idx, line, unnest(list_filter(range(1, length(line) + 1), lambda i: regexp_matches(substr(line, i, 1), '[A-Z]') AND (i = 1 OR NOT regexp_matches(substr(line, i - 1, 1), '[A-Za-z0-9_]')))) AS s FROM f_units),
 oc AS (SELECT wp.doc_id, wp.idx, wp.line, wp.s, max(nn.n) AS n FROM wp JOIN nn ON nn.doc_id = wp.doc_id AND substr(wp.line, wp.s, nn.n) = nn.name
   WHERE NOT regexp_matches(substr(wp.line, wp.s + nn.n, 1), '[A-Za-z0-9_]') GROUP BY ALL),
 nx AS (SELECT a.doc_id, a.idx, a.s, a.n, a.line, min(b.s) AS next FROM oc a LEFT JOIN oc b ON b.doc_id = a.doc_id AND b.idx = a.idx AND b.s >= a.s + a.n GROUP BY ALL),
 tk(doc_id, idx, s, n, line, next) AS (SELECT x.* FROM nx x JOIN (SELECT doc_id, idx, min(s) AS s FROM nx GROUP BY ALL) f ON f.doc_id = x.doc_id AND f.idx = x.idx AND f.s = x.s
   UNION ALL SELECT x.* FROM tk JOIN nx x ON x.doc_id = tk.doc_id AND x.idx = tk.idx AND x.s = tk.next),
 us AS (SELECT doc_id, idx, name, row_number() OVER (PARTITION BY doc_id, idx ORDER BY s) - 1 AS ord FROM (SELECT doc_id, idx, substr(line, s, n) AS name, min(s) AS s FROM tk GROUP BY ALL))"""


@REG.add("h16_terms_in", f"WITH RECURSIVE {TERMS} SELECT doc_id, idx, string_agg(name, '|' ORDER BY ord) AS names FROM us GROUP BY ALL")
def h16(v):
    """Names of a document's definitions in each of its lines."""
    v.keep("units")
    used = D.terms_in(v.of("units").select("doc_id", "idx", C("line").alias("text")), v.definition_names)
    return used.where(F.size("names") > 0).withColumn("names", F.array_join("names", "|"))


@REG.add(
    "h17_relevant_definitions",
    f"""WITH RECURSIVE {TERMS}, ky AS (SELECT us.doc_id, us.idx, nn.term, min((1000 - length(us.name)) * 100000 + us.ord) AS key FROM us JOIN nn ON nn.doc_id = us.doc_id AND nn.name = us.name
  WHERE us.name NOT IN ('The', 'Of', 'And', 'In') AND nn.term NOT IN ('The', 'Of', 'And', 'In') GROUP BY ALL)
 SELECT doc_id, idx, term, row_number() OVER (PARTITION BY doc_id, idx ORDER BY key) AS rank FROM ky""",
)
def h17(v):
    v.keep("units")
    names = v.definition_names
    used = D.terms_in(v.of("units").select("doc_id", "idx", C("line").alias("text")), names)
    return D.relevant_definitions(used, names, None, ("The", "Of", "And", "In"))


@REG.add("h18_extract_refs", "SELECT doc_id, source, wanted FROM f_raw_refs")
def h18(v):
    return D.extract_refs(v.of("units").withColumn("body", C("ref_body"))).drop("explicit")


@REG.add("h19_edges", "SELECT doc_id, source, target, found FROM f_refs")
def h19(v):
    v.keep("units")
    return v.of("refs")


@REG.add(
    "h20_expand",
    """WITH e AS (SELECT doc_id, source, target FROM f_refs WHERE found), s AS (SELECT DISTINCT doc_id, citation FROM f_units WHERE level = 1),
 h1 AS (SELECT DISTINCT e.doc_id, e.target AS citation FROM s JOIN e ON e.doc_id = s.doc_id AND e.source = s.citation WHERE NOT EXISTS (SELECT 1 FROM s x WHERE x.doc_id = e.doc_id AND x.citation = e.target)),
 h2 AS (SELECT DISTINCT e.doc_id, e.target AS citation FROM h1 JOIN e ON e.doc_id = h1.doc_id AND e.source = h1.citation
  WHERE NOT EXISTS (SELECT 1 FROM s x WHERE x.doc_id = e.doc_id AND x.citation = e.target) AND NOT EXISTS (SELECT 1 FROM h1 x WHERE x.doc_id = e.doc_id AND x.citation = e.target))
 SELECT doc_id, citation, 0::BIGINT AS hop FROM s UNION ALL SELECT doc_id, citation, 1 FROM h1 UNION ALL SELECT doc_id, citation, 2 FROM h2""",
)
def h20(v):
    v.keep("units")
    return D.expand(v.of("units").where("level = 1"), v.edges, 2)


@REG.add(
    "h21_cited_by",
    "SELECT doc_id, target, count(*) AS n, string_agg(source, '|' ORDER BY source) AS sources FROM f_refs WHERE found GROUP BY ALL",
)
def h21(v):
    v.keep("units")
    return D.cited_by(v.edges)


VOCAB = """WITH hd AS (SELECT doc_id, idx, citation, trim(regexp_replace(regexp_extract(title, '^(?:\\([A-Za-z0-9]{1,5}\\)\\s*)*(?:Section\\s+\\d+\\.\\s*)?([A-Z][^.:]{2,69})[.:]', 1), '\\s+', ' ', 'g')) AS name FROM f_units),
 w AS (SELECT *, string_split(name, ' ') AS ws FROM hd WHERE name <> ''),
 ok AS (SELECT doc_id, lower(name) AS name, citation, 'heading' AS kind, idx AS ord FROM w WHERE len(ws) <= 12 AND len(list_filter(ws, lambda x: regexp_matches(x, '^[A-Za-z]'))) > 0
  AND len(list_filter(ws, lambda x: regexp_matches(x, '^[A-Z]'))) >= 0.6 * len(list_filter(ws, lambda x: regexp_matches(x, '^[A-Za-z]')))),
 df AS (SELECT n.doc_id, lower(n.name), d.citation, 'definition', 1000000 + d.idx FROM f_definition_names n JOIN f_definitions d ON d.doc_id = n.doc_id AND d.term = n.term),
 vocab AS (SELECT doc_id, name, arg_min(citation, ord) AS citation, arg_min(kind, ord) AS kind FROM (SELECT * FROM ok UNION ALL SELECT * FROM df) GROUP BY ALL)"""


def vocab(v):
    return D.vocabulary(v.of("units"), v.definition_names)


@REG.add("h22_vocabulary", VOCAB + " SELECT * FROM vocab")
def h22(v):
    v.keep("units")
    return vocab(v)


@REG.add(
    "h23_resolve_terms",
    VOCAB + " SELECT u.doc_id, u.idx, v.citation, v.kind FROM f_units u JOIN vocab v ON v.doc_id = u.doc_id AND v.name = lower(u.first1)",
)
def h23(v):
    v.keep("units")
    words = F.split(F.trim(F.regexp_replace("line", "[^A-Za-z]+", " ")), " ")
    asked = v.of("units").select("doc_id", "idx", F.concat(F.lit("  "), F.upper(words[0]), F.lit(" ")).alias("name"))
    return D.resolve_terms(asked, vocab(v)).select("doc_id", "idx", "citation", "kind")


@REG.add(
    "h24_citation_map",
    """SELECT u.doc_id, u.citation, arg_min(c.idx, c."end" - c.start) AS chunk_idx, arg_min(c.citation = u.citation, c."end" - c.start) AS exact, u.start AS unit_start, u.subtree_end AS unit_end
 FROM f_by_citation u JOIN f_chunks c ON c.doc_id = u.doc_id AND c.start <= u.start AND u.start < c."end" GROUP BY u.doc_id, u.citation, u.start, u.subtree_end""",
)
def h24(v):
    v.keep("outlined", "chunks")
    return D.citation_map(v.of("outlined"), v.of("chunks"))


@REG.add(
    "h25_chunks_within",
    """SELECT * FROM (SELECT u.doc_id, u.citation, c.idx AS chunk_idx, c.citation AS chunk_citation, c.ordinal AS chunk_ordinal, c.start AS chunk_start,
 row_number() OVER (PARTITION BY u.doc_id, u.citation ORDER BY c.start, c.idx) AS rank
 FROM f_by_citation u JOIN f_chunks c ON c.doc_id = u.doc_id AND c.start >= u.start AND c.start < u.subtree_end)""",
)
def h25(v):
    v.keep("outlined", "chunks")
    return D.chunks_within(v.of("units").select("doc_id", "citation").distinct(), v.of("outlined"), v.of("chunks"))


@REG.add(
    "h26_definition_for",
    """SELECT a.doc_id, a.name, n.term, d.citation FROM (SELECT DISTINCT doc_id, first1 AS name FROM f_units) a JOIN f_definition_names n ON n.doc_id = a.doc_id AND n.name = a.name
 JOIN f_definitions d ON d.doc_id = n.doc_id AND d.term = n.term""",
)
def h26(v):
    v.keep("units")
    words = F.split(F.trim(F.regexp_replace("line", "[^A-Za-z]+", " ")), " ")
    asked = v.of("units").select("doc_id", F.initcap(words[0]).alias("name")).distinct()
    return D.definition_for(asked, v.definition_names).drop("at")


@REG.add(
    "h27_name_candidates",
    """SELECT * FROM (SELECT name, term, row_number() OVER (PARTITION BY name ORDER BY term) AS rank FROM (
 SELECT DISTINCT r.request AS name, p.p_name AS term FROM (SELECT request, unnest(string_split(lower(request), ' ')) AS word FROM f_requests WHERE request NOT IN (SELECT p_name FROM part)) r
 JOIN (SELECT DISTINCT p_name FROM part) p ON contains(p.p_name, r.word) WHERE length(r.word) > 3))""",
)
def h27(v):
    return matching.name_candidates(
        v.requests.withColumnRenamed("request", "name"), v.part.select(C("p_name").alias("term"))
    )
