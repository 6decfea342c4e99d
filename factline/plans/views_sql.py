"""The derived inputs of `views.py`, stated as SQL for the check."""

VIEWS = {
    "f_teams": """
SELECT s_suppkey AS team, s_name AS name, n_name AS division, r_name AS conference,
       CAST(round(s_acctbal * 100) AS BIGINT) AS balance
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
""",
    "f_players": """
SELECT p_partkey AS player, 'p' || p_partkey AS player_key, p_name AS display_name,
       CAST(p_size // 4 AS BIGINT) AS years_of_service,
       DATE '1955-01-01' + CAST(round((p_retailprice - 900) * 200) AS INTEGER) AS birth_date,
       p_type AS kind, p_brand AS brand, CAST(p_size AS BIGINT) AS size
FROM part
""",
    "f_seasons": """
SELECT season, season || '-' || (season + 1) AS season_id, cap AS salary_cap,
       cap + 30000000 AS tax_level, cap + 60000000 AS first_apron,
       CASE WHEN season = 1996 THEN 0 ELSE cap + 90000000 END AS raw_second,
       cap + 90000000 AS second_apron,
       cap * 9 // 100 AS non_taxpayer_mle, cap * 4 // 100 AS taxpayer_mle
FROM (SELECT range AS season, 440000000 + (range - 1997) * 4000000 AS cap FROM range(1994, 2002))
""",
    "f_lines": """
SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
                 CAST(round(l_extendedprice * 100) AS BIGINT)) AS contract_id,
       l_orderkey AS order_id, l_suppkey AS team, l_partkey AS player,
       CAST(l_linenumber AS BIGINT) AS line_no,
       CAST(round(l_extendedprice * 100) AS BIGINT) AS cap_figure,
       CAST(round(l_discount * 100) AS BIGINT) AS disc,
       CAST(round(l_tax * 100) AS BIGINT) AS tax, l_discount AS pct,
       CAST(l_quantity AS BIGINT) AS qty, l_returnflag AS flag, l_linestatus AS status,
       CAST(l_shipdate AS DATE) AS signed_date
FROM lineitem
""",
    "f_contract_seasons": """
SELECT l.*, o.season, o.as_of, o.source, o.season || '-' || (o.season + 1) AS season_id,
       CASE flag WHEN 'A' THEN 'player' WHEN 'R' THEN 'team' END AS option_kind,
       CASE WHEN tax = 0 THEN 'absent' WHEN disc = 0 THEN 'unknown' ELSE 'known' END AS kicker_state,
       CASE WHEN flag = 'A' THEN 'unknown' WHEN flag = 'R' AND status = 'O' THEN 'known'
            ELSE 'absent' END AS ntc_state,
       CASE WHEN tax = 0 THEN 'full' WHEN flag = 'A' THEN 'partial' WHEN flag = 'R' THEN 'none' ELSE 'unknown' END AS guarantee_kind,
       CASE line_no WHEN 1 THEN 'rookie_first_round' WHEN 2 THEN 'rookie_second_round'
            WHEN 3 THEN 'sign_and_trade' ELSE 'unknown' END AS contract_type
FROM f_lines l JOIN (
  SELECT o_orderkey, CAST(o_orderdate AS DATE) AS as_of, o_orderpriority AS source,
         year(o_orderdate) - CASE WHEN month(o_orderdate) < 7 THEN 1 ELSE 0 END AS season
  FROM orders) o ON l.order_id = o.o_orderkey
""",
    "f_years": """
SELECT contract_id, team, player, option_kind, signed_date, flag, disc, season AS first_season,
       k, season + k AS season,
       cap_figure + cap_figure * 5 * k // 100 AS cap_figure,
       CASE WHEN k = 0 THEN 'full' WHEN flag = 'A' THEN 'partial' WHEN flag = 'R' THEN 'none'
            ELSE 'unknown' END AS guarantee_kind
FROM (SELECT *, unnest(range(least(line_no, 5))) AS k FROM f_contract_seasons)
""",
    "f_holds": """
SELECT contract_id, team, player, source, as_of, 'hold' AS kind, cap_figure // 4 AS amount,
       CASE WHEN flag <> 'R' THEN season END AS season,
       CASE line_no WHEN 1 THEN 'Bird' WHEN 2 THEN 'Early Bird' WHEN 3 THEN 'Non-Bird'
            WHEN 4 THEN 'Restricted Bird' WHEN 5 THEN '1st Round Pick' ELSE 'Two-Way' END AS label,
       CASE WHEN tax = 0 THEN 0 ELSE cap_figure // 4 // 2 END AS offer
FROM f_contract_seasons WHERE status = 'O' AND disc >= 8
""",
    "f_dead": """
SELECT contract_id, team, player, season, cap_figure // 10 AS amount
FROM f_contract_seasons WHERE tax >= 8
""",
    "f_ceilings": """
SELECT c.*, s.season, s.season_id FROM (
SELECT team, 'first_apron' AS level, division AS category,
       CASE WHEN balance >= 0 THEN name END AS detail
FROM f_teams WHERE balance < 300000
UNION ALL
SELECT team, 'second_apron', division, CASE WHEN balance >= 0 THEN name END
FROM f_teams WHERE balance BETWEEN 100000 AND 600000) c
JOIN f_seasons s ON (c.team + s.season + length(c.level)) % 3 <> 0
""",
    "f_exceptions": """
SELECT contract_id, team, cap_figure AS amount, cap_figure * disc // 10 AS used,
       signed_date AS created,
       CASE WHEN tax > 0 THEN CAST(signed_date + INTERVAL 12 MONTH AS DATE) END AS expires,
       CASE WHEN line_no <= 4 THEN 'trade' WHEN line_no = 5 THEN 'disabled_player' END AS kind
FROM f_lines WHERE flag = 'R'
""",
    "f_picks": """
SELECT team AS original_team, year, round, CASE WHEN (team * 7 + year + round - 1) % 5 = 0 THEN team + 1 ELSE team END AS owner,
       (team + year + round - 1) % 11 = 0 AS forfeited, team % 10 AS protected_to
FROM (SELECT team, year, unnest([1::BIGINT, 2::BIGINT]) AS round FROM (SELECT team, unnest(range(2027, 2034)) AS year FROM f_teams))
""",
    "f_restrictions": """
SELECT player, CASE WHEN kind = 'ECONOMY' THEN 're_signed_with_raise' ELSE 'recently_signed' END AS reason,
       CASE WHEN size < 50 THEN DATE '1996-01-01' + CAST((size - 40) * 220 AS INTEGER) END AS expires,
       kind <> 'ECONOMY' AS blocks_trade
FROM f_players WHERE size >= 40
""",
    "f_totals": """
SELECT k.team, k.season, coalesce(c.committed, 0) AS committed, coalesce(c.standard_count, 0) AS standard_count,
       coalesce(d.dead, 0) AS dead, coalesce(h.holds, 0) + coalesce(hn.holds, 0) AS holds,
       coalesce(h.restricted, 0) + coalesce(hn.restricted, 0) AS restricted
FROM (SELECT DISTINCT team, season FROM f_contract_seasons) k
LEFT JOIN (SELECT team, season, CAST(sum(cap_figure) AS BIGINT) AS committed,
                  count(*) FILTER (cap_figure > 0) AS standard_count
           FROM f_contract_seasons GROUP BY ALL) c ON c.team = k.team AND c.season = k.season
LEFT JOIN (SELECT team, season, CAST(sum(amount) AS BIGINT) AS dead FROM f_dead GROUP BY ALL) d
       ON d.team = k.team AND d.season = k.season
LEFT JOIN (SELECT team, season, CAST(sum(amount) AS BIGINT) AS holds,
                  CAST(coalesce(sum(CASE WHEN offer > 0 THEN offer ELSE amount END)
                       FILTER (label LIKE 'Restricted%'), 0) AS BIGINT) AS restricted
           FROM f_holds WHERE season IS NOT NULL GROUP BY ALL) h ON h.team = k.team AND h.season = k.season
LEFT JOIN (SELECT team, CAST(sum(amount) AS BIGINT) AS holds,
                  CAST(coalesce(sum(CASE WHEN offer > 0 THEN offer ELSE amount END)
                       FILTER (label LIKE 'Restricted%'), 0) AS BIGINT) AS restricted
           FROM f_holds WHERE season IS NULL GROUP BY ALL) hn ON hn.team = k.team
""",
    "f_positions": """
SELECT t.team, t.season, s.season_id, t.committed, t.dead, t.holds, t.restricted,
       t.committed + t.dead + t.holds AS cap_salary,
       t.committed + t.dead + t.restricted AS apron_salary, t.standard_count,
       s.salary_cap, s.tax_level, s.first_apron, s.second_apron,
       CASE WHEN t.committed + t.dead + t.holds < s.salary_cap THEN 'room'
            WHEN t.committed + t.dead + t.restricted < s.tax_level THEN 'over_cap'
            WHEN t.committed + t.dead + t.restricted < s.first_apron THEN 'taxpayer'
            WHEN t.committed + t.dead + t.restricted < s.second_apron THEN 'first_apron'
            ELSE 'second_apron' END AS status,
       c.level AS ceiling_level,
       CASE c.level WHEN 'first_apron' THEN s.first_apron WHEN 'second_apron' THEN s.second_apron END AS ceiling_amount,
       c.triggers
FROM f_totals t JOIN f_seasons s ON t.season = s.season
LEFT JOIN (SELECT team, season, min(level) AS level, string_agg(DISTINCT trig, ' | ' ORDER BY trig) AS triggers
           FROM (SELECT team, season, level, concat_ws(' — ', category, detail) AS trig FROM f_ceilings)
           GROUP BY team, season) c ON c.team = t.team AND c.season = t.season
""",
    "f_moves": """
SELECT c.order_id AS trade_id, c.season, c.season_id, c.as_of + 120 AS trade_date, c.contract_id,
       c.player, c.team AS from_team, CASE WHEN c.team = e.hi THEN e.lo ELSE e.hi END AS to_team,
       c.cap_figure AS amount, c.kicker_state, c.pct, c.signed_date
FROM f_contract_seasons c
JOIN (SELECT l_orderkey, min(l_suppkey) AS lo, max(l_suppkey) AS hi FROM lineitem GROUP BY 1) e
  ON e.l_orderkey = c.order_id
""",
    "f_trade_errors": """
SELECT trade_id, count(*) AS n_moves,
       CASE WHEN min(from_team) = max(from_team) AND min(to_team) = max(to_team) AND min(from_team) = min(to_team)
              THEN 'one_team'
            WHEN count(*) FILTER (from_team = to_team) > 0 THEN 'self_move'
            WHEN count(DISTINCT player) < count(*) THEN 'player_twice' END AS error
FROM f_moves GROUP BY trade_id
""",
    "f_valid_moves": """
SELECT m.* FROM f_moves m WHERE m.trade_id IN (SELECT trade_id FROM f_trade_errors WHERE error IS NULL)
""",
    "f_move_legs": """
SELECT trade_id, season, season_id, trade_date, contract_id, player, from_team AS team, 'send' AS direction,
       amount, kicker_state, pct, signed_date FROM f_valid_moves
UNION ALL
SELECT trade_id, season, season_id, trade_date, contract_id, player, to_team, 'receive',
       amount, kicker_state, pct, signed_date FROM f_valid_moves
""",
    "f_legs": """
SELECT l.*, p.season_id, p.apron_salary, p.cap_salary, p.standard_count, p.status, p.salary_cap,
       p.tax_level, p.first_apron, p.second_apron, p.ceiling_level, p.ceiling_amount, p.triggers,
       440000000 AS base_cap,
       p.apron_salary - l.outgoing + l.incoming AS post_salary,
       CASE WHEN p.apron_salary - l.outgoing + l.incoming > p.first_apron THEN 0 ELSE 250000 END AS cushion,
       CASE WHEN p.salary_cap - p.cap_salary > 0 THEN p.salary_cap - p.cap_salary END AS cap_room
FROM (
  SELECT trade_id, team, season, trade_date,
         CAST(coalesce(sum(amount) FILTER (direction = 'send'), 0) AS BIGINT) AS outgoing,
         CAST(coalesce(sum(trunc(amount * (1 + CASE WHEN kicker_state = 'known' THEN pct ELSE 0 END)))
              FILTER (direction = 'receive'), 0) AS BIGINT) AS incoming,
         CAST(coalesce(sum(amount) FILTER (direction = 'receive'), 0) AS BIGINT) AS incoming_base,
         count(*) FILTER (direction = 'send') AS n_sends,
         count(*) FILTER (direction = 'receive') AS n_receives,
         count(*) FILTER (direction = 'receive' AND kicker_state = 'unknown') AS n_unknown_kickers
  FROM f_move_legs GROUP BY ALL) l
JOIN f_positions p ON p.team = l.team AND p.season = l.season
""",
    "f_awards": """
SELECT season, player, 'All-NBA' AS award, CASE r WHEN 1 THEN '1st' WHEN 2 THEN '2nd' ELSE '3rd' END AS tier
FROM (SELECT *, row_number() OVER (PARTITION BY season ORDER BY cap_figure DESC, contract_id) AS r
      FROM f_contract_seasons) WHERE r <= 3
""",
    "f_requests": """
SELECT DISTINCT CASE WHEN p_size <= 12 THEN p_name
  WHEN p_size <= 24 THEN substring(p_name, 3, length(p_name) - 3)
  WHEN p_size <= 36 THEN 'old ' || split_part(p_name, ' ', -1)
  ELSE 'qqq ' || lower(p_type) END AS request FROM part
""",
    "f_lookup": """
SELECT * FROM (
  SELECT request, player_key, display_name, how, CASE how WHEN 'exact' THEN 1 ELSE row_number() OVER
    (PARTITION BY request ORDER BY length(player_key), player_key) END AS rank FROM (
    SELECT r.request, n.player_key, n.display_name, n.how FROM f_requests r, LATERAL (
      SELECT DISTINCT p_name AS player_key, upper(split_part(p_name, ' ', 1)[1]) || split_part(p_name, ' ', 1)[2:] || ' ' ||
        upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:] AS display_name,
        CASE WHEN p_name = r.request THEN 'exact' WHEN contains(p_name, r.request) THEN 'substring' ELSE 'surname' END AS how
      FROM part WHERE contains(p_name, split_part(r.request, ' ', -1))) n
    QUALIFY n.how = min(n.how) OVER (PARTITION BY r.request)))
WHERE how = 'exact' OR rank <= 8
""",
    "f_parts": """
SELECT 0 AS n, []::BIGINT[] AS masks
UNION ALL
SELECT n + 1, CASE WHEN k <= len(masks)
  THEN list_transform(masks, lambda m, i: CASE WHEN i = k THEN m + CAST(pow(2, n) AS BIGINT) ELSE m END)
  ELSE list_append(masks, CAST(pow(2, n) AS BIGINT)) END
FROM f_parts, range(1, 10) t(k) WHERE n < 8 AND k <= len(masks) + 1
""",
}


def group_allowance(x: str, single: str, cushion: str, cap: str, no_e: str, no_a: str) -> str:
    """The most one exception permits against a group summing to x."""
    return (
        f"greatest(CASE WHEN {single} OR NOT ({no_a}) THEN {x} + {cushion} ELSE 0 END, "
        f"CASE WHEN {no_e} THEN 0 ELSE greatest(least({x} * 2 + {cushion}, "
        f"{x} + CAST(trunc({cap}::DOUBLE * 7500000 / 440000000) AS BIGINT)), "
        f"CAST(trunc({x} * 1.25::DOUBLE) AS BIGINT) + {cushion}) END)"
    )


def _structure(no_e: str, no_a: str, name: str) -> str:
    each = group_allowance("z[2]", "bit_count(z[1]) = 1", "cushion", "salary_cap", no_e, no_a)
    whole = group_allowance("whole", "false", "cushion", "salary_cap", no_e, no_a)
    single = group_allowance("x", "true", "cushion", "salary_cap", no_e, no_a)
    return f"""
SELECT trade_id, team, max(CASE WHEN n <= 8 THEN list_sum(list_transform(list_zip(masks, sums), lambda z: {each}))
  ELSE greatest({whole}, list_sum(list_transform(vals, lambda x: {single}))) END)::BIGINT AS {name}
FROM f_splits GROUP BY trade_id, team
"""


_TRANSITION = "(CASE WHEN season_id = '1998-1999' THEN CAST(trunc(outgoing * 1.10::DOUBLE) AS BIGINT) + cushion END)"
_EXPANDED = (
    "greatest(least(outgoing * 2 + cushion, outgoing + CAST(trunc(salary_cap::DOUBLE * 7500000 / base_cap) AS BIGINT)), "
    "CAST(trunc(outgoing * 1.25::DOUBLE) AS BIGINT) + cushion)"
)


def _best(no_t: str, no_e: str, no_a: str) -> str:
    return f"""CASE WHEN cap_room > 0 AND incoming <= cap_room + cushion THEN 'room'
 WHEN n_sends < 2 AND incoming <= outgoing + cushion THEN 'standard'
 WHEN n_sends >= 2 AND NOT ({no_a}) AND incoming <= outgoing + cushion THEN 'aggregated'
 WHEN NOT ({no_t}) AND incoming <= {_TRANSITION} THEN 'transition'
 WHEN NOT ({no_e}) AND incoming <= {_EXPANDED} THEN 'expanded' END"""


VIEWS["f_need"] = f"""
SELECT *, {_best('bar_g', 'bar_e', 'bar_h')} AS kind_barred, {_best('false', 'false', 'false')} AS kind_free FROM (
SELECT *, post_salary > first_apron AS bar_e,
 post_salary > first_apron AND season_id <> '1998-1999' AS bar_g,
 post_salary > second_apron AND season_id <> '1998-1999' AS bar_h
FROM f_legs WHERE incoming > outgoing)
"""
VIEWS["f_splits"] = """
SELECT s.*, p.masks, list_transform(p.masks, lambda m: list_sum(list_transform(s.vals, lambda x, i: CASE WHEN (m >> (i - 1)) & 1 = 1 THEN x ELSE 0 END))::BIGINT) AS sums
FROM (SELECT n.trade_id, n.team, n.cushion, n.salary_cap, n.bar_e, n.bar_h, count(*) AS n, sum(amount)::BIGINT AS whole,
        list(amount ORDER BY contract_id) AS vals
      FROM f_need n JOIN f_move_legs l ON l.trade_id = n.trade_id AND l.team = n.team AND l.direction = 'send' AND l.amount > 0
      WHERE n.kind_barred IS NULL AND n.n_sends > 1 GROUP BY ALL) s
LEFT JOIN f_parts p ON p.n = s.n
"""
VIEWS["f_structure_barred"] = _structure("bar_e", "bar_h", "total_barred")
VIEWS["f_structure_free"] = _structure("false", "false", "total_free")
VIEWS["f_matching"] = """
SELECT n.trade_id, n.team, n.outgoing, n.incoming, n.post_salary,
 CASE WHEN n.kind_barred IS NOT NULL OR n.incoming <= b.total_barred THEN NULL
      WHEN (n.bar_e OR n.bar_g OR n.bar_h) AND (n.kind_free IS NOT NULL OR n.incoming <= f.total_free) THEN 'apron_transaction_barred'
      ELSE 'no_exception_available' END AS code,
 CASE WHEN n.kind_barred IS NOT NULL THEN n.kind_barred WHEN n.incoming <= b.total_barred THEN 'structure' END AS used
FROM f_need n LEFT JOIN f_structure_barred b ON b.trade_id = n.trade_id AND b.team = n.team
LEFT JOIN f_structure_free f ON f.trade_id = n.trade_id AND f.team = n.team
"""
VIEWS["f_violations"] = """
SELECT trade_id, team, code, CAST(NULL AS BIGINT) AS subject FROM f_matching WHERE code IS NOT NULL
UNION ALL SELECT trade_id, team, 'hard_cap_ceiling_exceeded', NULL FROM f_legs WHERE post_salary > ceiling_amount
UNION ALL SELECT trade_id, team, 'roster_maximum_exceeded', NULL FROM f_legs WHERE standard_count - n_sends + n_receives > 15
UNION ALL SELECT s.trade_id, s.team, 'aggregation_two_month_bar', s.player FROM f_move_legs s JOIN f_legs l ON l.trade_id = s.trade_id AND l.team = s.team
 WHERE s.direction = 'send' AND l.n_sends >= 2 AND s.trade_date - s.signed_date < 60
UNION ALL SELECT s.trade_id, s.team, 'player_trade_restricted', s.player FROM f_move_legs s
 WHERE s.direction = 'send' AND EXISTS (SELECT 1 FROM f_restrictions r WHERE r.player = s.player AND r.blocks_trade AND (r.expires IS NULL OR s.trade_date <= r.expires))
"""
VIEWS["f_inventory"] = """
SELECT DISTINCT team, year FROM (SELECT original_team AS team, year FROM f_picks WHERE round = 1 UNION ALL SELECT owner, year FROM f_picks WHERE round = 1)
"""
VIEWS["f_pick_years"] = """
SELECT s.team, s.year, coalesce(h.held, false) AS held, coalesce(h.held, false) AND coalesce(h.lost, false) AS lost
FROM (SELECT team, unnest(range(min(year), max(year) + 1)) AS year FROM f_inventory GROUP BY team) s
LEFT JOIN (SELECT owner AS team, year, true AS held, bool_and(owner <> original_team AND protected_to > 0) AS lost
           FROM f_picks WHERE round = 1 AND NOT forfeited GROUP BY ALL) h ON h.team = s.team AND h.year = s.year
"""
VIEWS["f_asked"] = """
SELECT DISTINCT season, player, unnest([team, team + 1]) AS team FROM f_contract_seasons
"""
VIEWS["f_held"] = """
SELECT team, season, player, min(contract_id) AS contract_id, arg_min(cap_figure, contract_id) AS cap_figure,
 arg_min(kicker_state, contract_id) AS kicker_state, arg_min(ntc_state, contract_id) AS ntc_state,
 arg_min(signed_date, contract_id) AS signed_date, arg_min(contract_type, contract_id) AS contract_type
FROM f_contract_seasons GROUP BY team, season, player
"""
VIEWS["f_spans"] = """
SELECT event_id // 64 AS trace_id, event_id AS span_id,
 CASE WHEN event_id % 64 > 0 THEN event_id // 64 * 64 + (event_id % 64 - 1) // 4 END AS parent_id,
 CASE event_type WHEN 'signup' THEN 'agent' WHEN 'view' THEN 'retriever' WHEN 'click' THEN 'event' WHEN 'purchase' THEN 'generation' ELSE 'tool' END AS kind,
 event_type AS name, ts AS started_at, value
FROM events
"""
_CAP = "array_to_string(list_transform({w}, lambda x: upper(x[1]) || lower(x[2:])), ' ')"
VIEWS["f_docs"] = r"""
SELECT doc_id, array_to_string(list_filter(list_transform(string_split(regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g'), chr(10)),
  lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text, lang, source FROM documents
"""
VIEWS["f_doc_lines"] = """
SELECT doc_id, CAST(i - 1 AS BIGINT) AS idx, ls[i] AS line, doc_end FROM (
 SELECT doc_id, string_split(text, chr(10)) AS ls, CAST(length(text) + 1 AS BIGINT) AS doc_end, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM f_docs)
"""
VIEWS["f_units"] = f"""
SELECT *, CASE WHEN section IS NULL THEN 'Art. VII' ELSE 'Art. VII §' || section || markers END AS citation FROM (
SELECT doc_id, idx, level, line, start, doc_end, 'VII' AS article, is_section, section_level,
 CASE WHEN sec > 0 AND level > 1 THEN CAST(sec AS VARCHAR) END AS section,
 CASE WHEN sec > 0 AND level > 1 THEN CASE WHEN level = 4 AND m3 > 0 THEN letter || number WHEN level = 3 THEN letter WHEN level = 4 THEN number ELSE '' END ELSE '' END AS markers,
 CASE WHEN level = 4 AND m3 > 0 THEN letter || number WHEN level = 3 THEN letter WHEN level = 4 THEN number ELSE '' END AS all_markers,
 CASE level WHEN 1 THEN 'Article VII ' || line WHEN 2 THEN 'Section ' || sec || '. ' || first2 || '. ' || line WHEN 3 THEN letter || ' ' || first2 || ': ' || line ELSE number || ' ' || line END AS title,
 CASE WHEN level = 3 AND length(line) % 2 = 0 THEN letter || ' “' || first2 || '” means ' || line
  WHEN level = 3 THEN letter || ' The term “' || first2 || '” or “' || first1 || '” shall mean ' || line
  WHEN level = 4 AND length(line) % 4 = 0 THEN number || ' “' || first2 || '” (see “' || first1 || '”) ' || line ELSE line END AS body,
 line || CASE level WHEN 1 THEN ' See Article X, Section 1 and Section 2.' WHEN 2 THEN ' Under Article VII, Section ' || (length(line) % 4 + 1) || '(a)(2) and Section 401(a) of the Code.'
  WHEN 3 THEN ' As in Section ' || (length(line) % 6 + 1) || '(b)(1)(i).' ELSE ' Section 302(c)(5) of the Labor Management Relations Act of 1947, Section 1(a).' END AS ref_body, first1, first2
FROM (SELECT *, level = 2 AS is_section, CASE WHEN sec > 0 THEN 2 END AS section_level, '(' || repeat(chr(CAST(97 + (m3 - 1) % 26 AS INTEGER)), CAST((m3 - 1) // 26 + 1 AS BIGINT)) || ')' AS letter,
  '(' || ((m4 - 1) % 5 + 1) || ')' AS number FROM (
 SELECT *, CAST(sum(CASE WHEN level = 4 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, sec, m3 ORDER BY idx) AS BIGINT) AS m4 FROM (
 SELECT *, CAST(sum(CASE WHEN level = 3 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, sec ORDER BY idx) AS BIGINT) AS m3 FROM (
 SELECT *, CAST(sum(CASE WHEN level = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY idx) AS BIGINT) AS sec,
  {_CAP.format(w='words[1:2]')} AS first2, {_CAP.format(w='words[1:1]')} AS first1 FROM (
 SELECT doc_id, idx, line, doc_end, CAST(CASE WHEN idx = 0 THEN 1 ELSE 2 + length(line) % 3 END AS BIGINT) AS level,
  CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
  string_split(trim(regexp_replace(line, '[^A-Za-z]+', ' ', 'g')), ' ') AS words FROM f_doc_lines))))))
"""
VIEWS["f_outline"] = """
SELECT u.*, coalesce((SELECT min(n.start) FROM f_units n WHERE n.doc_id = u.doc_id AND n.idx > u.idx), u.doc_end) AS own_end,
 coalesce((SELECT min(n.start) FROM f_units n WHERE n.doc_id = u.doc_id AND n.idx > u.idx AND n.level <= u.level), u.doc_end) AS subtree_end,
 (SELECT max(n.idx) FROM f_units n WHERE n.doc_id = u.doc_id AND n.idx < u.idx AND n.level < u.level) AS parent
FROM f_units u
"""
VIEWS["f_inside"] = """
SELECT o.doc_id, o.idx, min(n.level) AS child_level, min(n.start) FILTER (n.level = m.lv) AS first_child
FROM f_outline o JOIN (SELECT o.doc_id, o.idx, min(n.level) AS lv FROM f_outline o JOIN f_units n ON n.doc_id = o.doc_id AND n.start > o.start AND n.start < o.subtree_end GROUP BY ALL) m
 ON m.doc_id = o.doc_id AND m.idx = o.idx
JOIN f_units n ON n.doc_id = o.doc_id AND n.start > o.start AND n.start < o.subtree_end GROUP BY ALL
"""
VIEWS["f_reached"] = """
SELECT o.doc_id, o.idx, o.start, o.subtree_end, caps.cap FROM f_outline o, (SELECT unnest([600, 300, 1200]) AS cap) caps WHERE o.is_section AND o.section IS NOT NULL
UNION ALL
SELECT c.doc_id, c.idx, c.start, c.subtree_end, r.cap FROM f_reached r JOIN f_inside i ON i.doc_id = r.doc_id AND i.idx = r.idx
 JOIN f_outline c ON c.doc_id = r.doc_id AND c.start > r.start AND c.start < r.subtree_end AND c.level = i.child_level
WHERE r.subtree_end - r.start - 1 > r.cap
"""
VIEWS["f_all_chunks"] = """
SELECT r.cap, o.doc_id, o.idx, o.citation, o.level, o.start, CASE WHEN r.subtree_end - r.start - 1 > r.cap AND i.idx IS NOT NULL THEN i.first_child ELSE o.subtree_end END AS "end",
 r.subtree_end - r.start - 1 > r.cap AND i.idx IS NOT NULL AS preamble
FROM f_reached r JOIN f_outline o ON o.doc_id = r.doc_id AND o.idx = r.idx LEFT JOIN f_inside i ON i.doc_id = r.doc_id AND i.idx = r.idx
"""
VIEWS["f_chunks"] = """
SELECT *, "end" - start - 1 > cap AS oversized, row_number() OVER (PARTITION BY doc_id, citation ORDER BY start, idx) AS ordinal
FROM f_all_chunks WHERE cap = 600
"""
VIEWS["f_by_citation"] = """
SELECT doc_id, citation, min(start) AS start, arg_min(idx, start) AS idx, arg_min(subtree_end, start) AS subtree_end FROM f_outline GROUP BY ALL
"""
VIEWS["f_ancestors"] = r"""
SELECT doc_id, citation, d AS depth, head || array_to_string(list_transform(ms[1:len(ms) - d], lambda m: '(' || m || ')'), '') AS candidate
FROM (SELECT doc_id, citation, ms, head, unnest(range(0, len(ms) + 1)) AS d FROM (
 SELECT doc_id, citation, regexp_extract_all(citation, '\(([A-Za-z0-9]{1,5})\)', 1) AS ms, split_part(citation, '(', 1) AS head FROM f_cited))
"""
VIEWS["f_raw_refs"] = r"""
SELECT DISTINCT doc_id, source, 'Art. ' || CASE WHEN a <> '' THEN a ELSE 'VII' END || ' §' || s || coalesce(m, '') AS wanted FROM (
 SELECT doc_id, citation AS source, unnest(regexp_extract_all(ref_body, P, 1)) AS a, unnest(regexp_extract_all(ref_body, P, 2)) AS s,
  unnest(regexp_extract_all(ref_body, P, 3)) AS m, unnest(regexp_extract_all(ref_body, P, 4)) AS ext FROM f_units) WHERE coalesce(ext, '') = ''
""".replace("P,", r"'(?:Article\s+([IVXLC]+),?\s+)?Section\s+(\d+)((?:\([A-Za-z0-9]{1,5}\))*)(\s*of\s+(?:the\s+)?(?:[A-Z][\w.-]*\s+){0,6}(?:Code|Act|Act\s+of\s+\d{4})\b)?',")
VIEWS["f_cited"] = "SELECT DISTINCT doc_id, wanted AS citation FROM f_raw_refs"
VIEWS["f_resolved"] = """
SELECT c.doc_id, c.citation, arg_min(a.candidate, a.depth) FILTER (k.citation IS NOT NULL) AS resolved, min(a.depth) FILTER (k.citation IS NOT NULL) AS dropped
FROM f_cited c JOIN f_ancestors a ON a.doc_id = c.doc_id AND a.citation = c.citation
LEFT JOIN (SELECT DISTINCT doc_id, citation FROM f_units) k ON k.doc_id = a.doc_id AND k.citation = a.candidate GROUP BY ALL
"""
VIEWS["f_refs"] = """
SELECT r.doc_id, r.source, coalesce(x.resolved, r.wanted) AS target, bool_or(x.resolved IS NOT NULL) AS found
FROM f_raw_refs r JOIN f_resolved x ON x.doc_id = r.doc_id AND x.citation = r.wanted WHERE coalesce(x.resolved, r.wanted) <> r.source GROUP BY ALL
"""
VIEWS["f_definitions"] = """
SELECT doc_id, first2 AS term, min(idx) AS idx, arg_min(citation, idx) AS citation,
 arg_min(CASE WHEN length(line) % 2 = 0 THEN NULL ELSE first1 END, idx) AS raw_alias,
 arg_min(CASE WHEN length(line) % 2 = 0 THEN [] ELSE [first1] END, idx) AS aliases
FROM f_units WHERE level = 3 AND first2 <> '' GROUP BY ALL
"""
VIEWS["f_definition_names"] = """
WITH d AS (SELECT doc_id, term AS name, term, 0 AS p, idx FROM f_definitions UNION ALL SELECT doc_id, unnest(aliases), term, 1, idx FROM f_definitions),
 direct AS (SELECT doc_id, name, arg_min(term, p * 1000000 + idx) AS term FROM d GROUP BY ALL),
 ptr AS (SELECT doc_id, first2 AS name, arg_max(first1, idx) AS target, min(idx) AS idx FROM f_units WHERE level = 4 AND length(line) % 4 = 0 AND first2 <> '' GROUP BY ALL),
 one AS (SELECT p.doc_id, p.name, t.term, p.idx FROM ptr p JOIN direct t ON t.doc_id = p.doc_id AND t.name = p.target
   WHERE NOT EXISTS (SELECT 1 FROM direct x WHERE x.doc_id = p.doc_id AND x.name = p.name)),
 two AS (SELECT p.doc_id, p.name, o.term FROM ptr p JOIN one o ON o.doc_id = p.doc_id AND o.name = p.target AND o.idx < p.idx
   WHERE NOT EXISTS (SELECT 1 FROM direct x WHERE x.doc_id = p.doc_id AND x.name = p.name) AND NOT EXISTS (SELECT 1 FROM one x WHERE x.doc_id = p.doc_id AND x.name = p.name))
SELECT * FROM direct UNION ALL SELECT doc_id, name, term FROM one UNION ALL SELECT * FROM two
"""
VIEWS["f_leg_text"] = """
WITH b AS (SELECT trade_id, to_team AS team, from_team, string_agg('· $' || format('{:,}', amount) || ' ', '' ORDER BY contract_id) AS t FROM f_valid_moves GROUP BY ALL),
 h AS (SELECT trade_id, team, string_agg('From T' || from_team || ': ' || t, '' ORDER BY from_team) AS named, min(t) AS only_t FROM b GROUP BY ALL),
 n AS (SELECT trade_id, count(DISTINCT from_team) AS n_teams FROM f_valid_moves GROUP BY 1),
 x AS (SELECT l.*, n.n_teams, h.named, h.only_t, l.incoming_base + CASE WHEN l.season = 1996 AND l.n_receives >= 4 THEN 1000 ELSE 0 END AS total
  FROM f_legs l JOIN n ON n.trade_id = l.trade_id LEFT JOIN h ON h.trade_id = l.trade_id AND h.team = l.team)
SELECT trade_id, team, trade_date AS date, coalesce(CASE WHEN n_teams = 2 THEN only_t ELSE named END, '') || CASE WHEN n_receives >= 3 THEN '2027 1st round pick ' ELSE '' END ||
 'Cap Hit Sum: $' || format('{:,}', total) || ' Cap Hit Change: ' || CASE WHEN total >= outgoing THEN '+' ELSE '-' END || '$' || format('{:,}', abs(total - outgoing)) ||
 CASE WHEN n_sends = 1 THEN ' Cash: $' || format('{:,}', outgoing % 1000 + 100) ELSE '' END || CASE WHEN total < outgoing THEN ' Trade Exceptions Generated: 1' ELSE '' END AS detail FROM x
"""
VIEWS["f_parsed"] = """
SELECT trade_id, date, team, CAST(replace(regexp_extract(detail, 'Cap Hit Sum: .([0-9,]+)', 1), ',', '') AS BIGINT) AS incoming,
 CAST(replace(regexp_extract(detail, 'Cap Hit Sum: .([0-9,]+)', 1), ',', '') AS BIGINT) - CASE WHEN contains(detail, 'Change: +') THEN 1 ELSE -1 END *
  CAST(replace(regexp_extract(detail, 'Cap Hit Change: [+-].([0-9,]+)', 1), ',', '') AS BIGINT) AS outgoing,
 coalesce(TRY_CAST(replace(regexp_extract(detail, 'Cash: .([0-9,]+)', 1), ',', '') AS BIGINT), 0) AS cash_received,
 CAST(len(regexp_extract_all(detail, '20[0-9][0-9] (1st|2nd) round pick')) AS BIGINT) AS picks, contains(detail, 'Trade Exceptions Generated:') AS generated_tpe,
 list_transform(regexp_extract_all(split_part(detail, 'Cap Hit Sum', 1), '· .([0-9,]+)', 1), lambda x: CAST(replace(x, ',', '') AS BIGINT)) AS incoming_salaries
FROM f_leg_text
"""
VIEWS["f_cases"] = """
SELECT p.*, n_legs, total_in = total_out AS balanced FROM (SELECT *, (year(date) - CASE WHEN month(date) < 7 THEN 1 ELSE 0 END) || '-' || (year(date) + CASE WHEN month(date) < 7 THEN 0 ELSE 1 END) AS season_id FROM f_parsed) p
JOIN (SELECT trade_id, count(*) AS n_legs, sum(incoming) AS total_in, sum(outgoing) AS total_out FROM f_parsed WHERE date >= DATE '1996-07-01' GROUP BY 1) t ON t.trade_id = p.trade_id
WHERE p.season_id >= '1996-1997'
"""
VIEWS["f_sent"] = """
SELECT c.trade_id, c.team, m.to_team AS taker, m.amount FROM f_cases c JOIN f_valid_moves m ON m.trade_id = c.trade_id AND m.from_team = c.team
"""
VIEWS["f_case_splits"] = """
SELECT s.*, p.masks FROM (SELECT trade_id, team, list(amount) AS vals, count(*) AS n, sum(amount)::BIGINT AS total FROM f_sent GROUP BY ALL) s LEFT JOIN f_parts p ON p.n = s.n
"""
VIEWS["f_capacity"] = """
WITH k AS (SELECT c.*, s.salary_cap, coalesce(x.total = c.outgoing, false) AS reconstructed FROM f_cases c LEFT JOIN f_seasons s ON s.season_id = c.season_id
  LEFT JOIN (SELECT trade_id, team, sum(amount) AS total FROM f_sent GROUP BY ALL) x ON x.trade_id = c.trade_id AND x.team = c.team),
 b AS (SELECT k.trade_id, k.team, max(CASE WHEN s.n <= 8 THEN list_sum(list_transform(s.masks, lambda m: {each})) ELSE greatest({whole}, list_sum(list_transform(s.vals, lambda x: {single}))) END)::BIGINT AS best
  FROM k JOIN f_case_splits s ON s.trade_id = k.trade_id AND s.team = k.team WHERE k.reconstructed AND k.salary_cap IS NOT NULL GROUP BY ALL)
SELECT k.*, CASE WHEN reconstructed THEN coalesce(b.best, 0) ELSE {one} END AS capacity FROM k LEFT JOIN b ON b.trade_id = k.trade_id AND b.team = k.team
""".format(
    each=group_allowance("list_sum(list_transform(s.vals, lambda x, i: CASE WHEN (m >> (i - 1)) & 1 = 1 THEN x ELSE 0 END))::BIGINT", "bit_count(m) = 1", "250000", "salary_cap", "false", "false"),
    whole=group_allowance("s.total", "false", "250000", "salary_cap", "false", "false"),
    single=group_allowance("x", "true", "250000", "salary_cap", "false", "false"),
    one=group_allowance("outgoing", "true", "250000", "salary_cap", "false", "false"),
)
VIEWS["f_checks"] = """
SELECT trade_id, NULL::BIGINT AS team, CASE WHEN bool_or(salary_cap IS NOT NULL) THEN 'corpus_balance' ELSE 'season_constants' END AS "check",
 CASE WHEN NOT bool_or(salary_cap IS NOT NULL) THEN 'skipped' WHEN bool_and(balanced) THEN 'pass' ELSE 'fail' END AS outcome FROM f_capacity GROUP BY trade_id
UNION ALL SELECT trade_id, team, 'salary_matching', CASE WHEN incoming <= outgoing OR (reconstructed AND incoming <= capacity) OR incoming <= outgoing + 250000
  OR (season_id = '1998-1999' AND incoming <= CAST(trunc(outgoing * 1.10::DOUBLE) AS BIGINT) + 250000) OR incoming <= {one} THEN 'pass' ELSE 'skipped' END FROM f_capacity WHERE balanced AND salary_cap IS NOT NULL
UNION ALL SELECT trade_id, team, unnest(['hard_cap_ceiling', 'allowance_removal']), 'skipped' FROM f_capacity WHERE balanced AND salary_cap IS NOT NULL AND incoming > outgoing
""".format(one=group_allowance("outgoing", "true", "250000", "salary_cap", "false", "false"))
VIEWS["f_mutants"] = """
WITH s AS (SELECT * FROM f_capacity WHERE balanced AND salary_cap IS NOT NULL), l AS (SELECT * FROM s WHERE outgoing > 0 AND (incoming <= outgoing OR incoming <= capacity))
SELECT trade_id, team, outgoing, capacity, 'inflate_incoming' AS kind, greatest(incoming, outgoing) * 4 + 10000000 AS mutated FROM l WHERE greatest(incoming, outgoing) * 4 + 10000000 > capacity
UNION ALL SELECT trade_id, team, outgoing, capacity, 'just_over_the_band', capacity + 1 FROM l
UNION ALL SELECT trade_id, team, outgoing, capacity, 'unbalance', incoming + 7777777 FROM (SELECT *, row_number() OVER (PARTITION BY trade_id ORDER BY team) AS r FROM s WHERE incoming > 0) WHERE r = 1
"""
