"""The registered queries of the operators, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factline.llm import alignment, cover_tree, decontaminate, licenses, line_dedup, mixing, ngram_join, periodic, pieces, pii, secrets, spans, tokens, toxicity
from factline.llm.common import table
from factline.sources import scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def span_report(found: DataFrame, kinds: tuple[str, ...], counted: int) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans and all spans."""
    n = [spans.count(F.col("base"), k).alias(f"n_{kind}") for k, kind in enumerate(kinds[:counted])]
    return found.select("doc_id", *n, F.sha2(spans.joined(F.col("base"), kinds), 256).alias("base_sha256"), spans.joined(F.col("spans"), kinds).alias("spans"))


@query
def op1_pii_contexts(spark, sf_dir):
    return span_report(pii.extract(table(spark, sf_dir, "documents")), pii.KINDS, 4)


@query
def op2_secret_markov(spark, sf_dir):
    return span_report(secrets.extract(table(spark, sf_dir, "documents")), secrets.KINDS, 3)


@query
def op3_ngram_jaccard_join(spark, sf_dir):
    out = ngram_join.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_shingles", "component_id")


@query
def op4_token_orc(spark, sf_dir):
    path = scratch.fresh_path(spark, "token-orc")
    tokens.write(table(spark, sf_dir, "documents"), path)
    return tokens.digest(spark, path)


@query
def op5_license_scan(spark, sf_dir):
    out = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", *[f"licence.{c}" for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")])


@query
def op6_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op7_line_templates(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.cleaned(docs)
    n = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    return out.select("doc_id", "dropped_lines", n.alias("kept_chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query
def op8_cover_tree(spark, sf_dir):
    return cover_tree.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op9_mixing(spark, sf_dir):
    rows, _ = mixing.mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    posts = [F.get("post", F.lit(i)).alias(f"p_{d}") for i, d in enumerate(mixing.TARGETS)]
    return rows.select("doc_id", "n_tokens", *posts, "rate")


@query
def op10_decontaminate(spark, sf_dir):
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op11_periodic_runs(spark, sf_dir):
    return periodic.digest(periodic.detect(periodic.repeated(table(spark, sf_dir, "documents"))))


@query
def op12_sentence_pieces(spark, sf_dir):
    return pieces.digest(table(spark, sf_dir, "documents"))


@query
def op13_token_alignment(spark, sf_dir):
    return alignment.counted(table(spark, sf_dir, "documents"))


ORACLES["op3_ngram_jaccard_join"] = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS to_id FROM documents UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.to_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT id AS doc_id, min(to_id) AS component_id FROM r GROUP BY 1) m USING (doc_id)
"""

ORACLES["op7_line_templates"] = r"""
WITH raw AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, text, i AS line, ls[i] AS raw FROM raw, unnest(range(1, len(ls) + 1)) AS t(i)),
s AS (SELECT doc_id, text, line, raw, trim(regexp_replace(raw, '[ \t\r\f\x0B]+', ' ', 'g')) AS sp FROM l),
m AS (SELECT *, array_to_string(list_transform(string_split(sp, ' '), lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN '<*>' ELSE w END), ' ') AS m FROM s),
k AS (SELECT *, string_split(m, ' ') AS w FROM m),
u AS (SELECT m, w, len(w) AS n, w[1:3] AS lead, count(DISTINCT (doc_id, text)) AS docs FROM k WHERE len(w) >= 4 GROUP BY 1, 2, 3, 4),
leaf AS (SELECT n, lead, sum(docs) AS total FROM u GROUP BY 1, 2 HAVING count(*) > 1 AND sum(docs) >= CASE WHEN n > 50 THEN 2 ELSE 3 END),
x AS (SELECT u.m, u.n, u.lead, u.docs, i, u.w[i] AS word, leaf.total FROM u JOIN leaf USING (n, lead), unnest(range(1, u.n + 1)) AS t(i)),
c AS (SELECT n, lead, i, word FROM x GROUP BY n, lead, i, word, total HAVING sum(docs) >= 0.5 * total),
f AS (SELECT x.m, x.n, x.lead, x.docs, string_agg(CASE WHEN c.word IS NULL THEN '<*>' ELSE x.word END, ' ' ORDER BY x.i) AS shape,
        avg(CASE WHEN c.word IS NOT NULL AND c.word <> '<*>' THEN 1.0 ELSE 0.0 END) AS share
      FROM x LEFT JOIN c ON x.n = c.n AND x.lead = c.lead AND x.i = c.i AND x.word = c.word GROUP BY 1, 2, 3, 4),
h AS (SELECT f.n, f.lead, f.shape, count(DISTINCT (k.doc_id, k.text)) AS shape_docs FROM f JOIN k ON k.m = f.m WHERE f.share >= 0.6 GROUP BY 1, 2, 3),
g AS (SELECT f.m, h.n, h.shape_docs FROM f JOIN h ON h.n = f.n AND h.lead = f.lead AND h.shape = f.shape WHERE f.share >= 0.6),
drops AS (SELECT m FROM u WHERE docs >= CASE WHEN n > 50 THEN 2 ELSE 3 END AND 2 * (length(m) - length(replace(m, '<*>', ''))) / 3 <= n UNION SELECT m FROM g WHERE shape_docs >= CASE WHEN n > 50 THEN 2 ELSE 3 END),
o AS (SELECT k.doc_id, k.text, count(d.m) AS dropped, string_agg(CASE WHEN d.m IS NULL THEN k.raw END, chr(10) ORDER BY k.line) AS kept
      FROM k LEFT JOIN drops d ON d.m = k.m AND len(k.w) >= 4 GROUP BY 1, 2)
SELECT doc_id, dropped AS dropped_lines, length(coalesce(kept, '')) AS kept_chars, sha256(coalesce(kept, '')) AS kept_sha256 FROM o
"""

ORACLES["op8_cover_tree"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.93),
r AS (SELECT vec_id AS id, vec_id AS to_id FROM embeddings UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.to_id),
m AS (SELECT id AS vec_id, min(to_id) AS component_id FROM r GROUP BY 1),
c AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, coalesce(c.n, 0) AS n_links, m.component_id, vec_id = m.component_id AS kept
FROM embeddings JOIN m USING (vec_id) LEFT JOIN c USING (vec_id)
"""
