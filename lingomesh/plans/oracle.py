"""DuckDB SQL twins of the named queries (the correctness oracle).

Each statement runs on the driver tables registered as views.  The SQL restates the
operator contracts directly (string and list functions, window ranking, a recursive CTE
for the greedy walk); it shares no code with the Spark operators.
"""

from __future__ import annotations

# Unicode whitespace as Python's str.strip() sees it, as an RE2 class.
_WS = r"[\t\n\x0b\f\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_SPLIT = r"(?s)^[^:]*://([^/?#]*)([^?#]*)(?:\?([^#]*))?"
_NUM = r"[-+]?(?:\d*\.\d+|\d+)(?:[eE][-+]?\d+)?"
_TRACKING = ("'utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', "
             "'gclid', 'fbclid', 'mc_cid', 'mc_eid', 'pk_campaign', 'pk_kwd'")

PIVOT = "en"
THRESHOLD = "0.25::DOUBLE"
BAND = "0.05::DOUBLE"
MARGIN = "0.02::DOUBLE"
K = 5
OTHER_CODES = ["de", "es", "fr"]


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def norm_url_ctes(src: str, url: str, prefix: str) -> tuple[str, str]:
    """CTEs adding ``norm_url`` to every row of ``src``; returns (sql, final cte name)."""
    dec = lambda e: f"url_decode(replace({e}, '+', ' '))"
    enc = lambda e: f"replace(url_encode({e}), '%20', '+')"
    sql = f"""
{prefix}0 AS (SELECT *, {trim(f"coalesce(CAST({url} AS VARCHAR), '')")} AS nu_s0 FROM {src}),
{prefix}1 AS (SELECT *, regexp_replace(CASE WHEN regexp_matches(nu_s0, '(?i)^https?://') THEN nu_s0 ELSE 'https://' || nu_s0 END,
                 '[\\t\\r\\n]', '', 'g') AS nu_s1 FROM {prefix}0),
{prefix}2 AS (SELECT *, regexp_extract(nu_s1, '{_SPLIT}', 1) AS nu_net, regexp_extract(nu_s1, '{_SPLIT}', 2) AS nu_path,
                 regexp_extract(nu_s1, '{_SPLIT}', 3) AS nu_q FROM {prefix}1),
{prefix}3 AS (SELECT *,
   lower(CASE WHEN strpos(regexp_replace(nu_net, '(?s)^.*@', ''), '[') > 0
              THEN regexp_extract(regexp_replace(nu_net, '(?s)^.*@', ''), '\\[([^\\]]*)', 1)
              ELSE split_part(regexp_replace(nu_net, '(?s)^.*@', ''), ':', 1) END) AS nu_host0,
   regexp_replace(nu_path, ';[^/]*$', '') AS nu_p1,
   list_transform(list_filter(string_split(nu_q, '&'), lambda x: x <> ''),
       lambda x: {{'k': {dec("split_part(x, '=', 1)")},
                  'v': {dec("CASE WHEN strpos(x, '=') > 0 THEN substr(x, strpos(x, '=') + 1) ELSE '' END")}}}) AS nu_pairs
   FROM {prefix}2),
{prefix} AS (SELECT * EXCLUDE (nu_s0, nu_s1, nu_net, nu_path, nu_q, nu_host0, nu_p1, nu_pairs),
   CASE WHEN nu_s0 = '' OR lower(nu_s0) = 'nan' THEN ''
        WHEN (strpos(nu_net, '[') > 0) <> (strpos(nu_net, ']') > 0) THEN nu_s0
        WHEN strpos(nu_net, '[') > 0 AND NOT regexp_matches(regexp_extract(nu_net, '\\[([^\\]]*)', 1),
             '(?i)^(v[0-9a-f]+\\..+|[0-9a-f.]*:[0-9a-f:.]*(%.*)?)$') THEN nu_s0
        ELSE regexp_replace(nu_host0, '^www\\.', '')
             || CASE WHEN nu_p1 IN ('', '/') THEN '/' ELSE regexp_replace(nu_p1, '/+$', '') END
             || CASE WHEN len(list_filter(nu_pairs, lambda p: lower(p.k) NOT IN ({_TRACKING}))) > 0
                     THEN '?' || array_to_string(list_transform(
                          list_sort(list_filter(nu_pairs, lambda p: lower(p.k) NOT IN ({_TRACKING}))),
                          lambda p: {enc("p.k")} || '=' || {enc("p.v")}), '&')
                     ELSE '' END
   END AS norm_url FROM {prefix}3)"""
    return sql, prefix


def strip_language(norm: str, code: str) -> str:
    path = f"(CASE WHEN strpos({norm}, '/') > 0 THEN substr({norm}, strpos({norm}, '/')) ELSE '/' END)"
    lang = f"lower(split_part({trim(code)}, '-', 1))"
    first = f"lower(coalesce(string_split({path}, '/')[2], ''))"
    same = (f"({first} <> '' AND ({first} = lower({code}) OR {first} = {lang} OR "
            f"(regexp_matches({first}, '(?i)^[a-z]{{2}}(-[a-z]{{2}})?$') AND lower(split_part({first}, '-', 1)) = {lang})))")
    return f"('*' || CASE WHEN {same} THEN regexp_replace({path}, '^/[^/]*/?', '/') ELSE {path} END)"


def to_float(d: str) -> str:
    """DOUBLE → FLOAT the way a float32 cast rounds: overflow becomes ±inf, not NULL."""
    return f"coalesce(TRY_CAST({d} AS FLOAT), (sign({d}) * 'inf'::DOUBLE)::FLOAT)"


def parse_vector(s: str) -> str:
    """Vector text → FLOAT[] (JSON array of numbers, else every number by pattern)."""
    t = trim(f"coalesce({s}, '')")
    elems = f"TRY(json_transform({t}, '[\"VARCHAR\"]'))"
    elem_ok = ("list_bool_and(list_transform(e, lambda x: x IS NULL OR x IN ('true', 'false') OR "
               "TRY_CAST(regexp_replace(x, '^\"(.*)\"$', '\\1') AS DOUBLE) IS NOT NULL))")
    elem_val = ("list_transform(e, lambda x: CASE WHEN x IS NULL THEN 'NaN'::FLOAT WHEN x = 'true' THEN 1::FLOAT "
                "WHEN x = 'false' THEN 0::FLOAT ELSE " + to_float("TRY_CAST(regexp_replace(x, '^\"(.*)\"$', '\\1') AS DOUBLE)") + " END)")
    nums = f"regexp_extract_all({t}, '{_NUM}')"
    return f"""(CASE WHEN {t} = '' OR lower({t}) = 'nan' THEN NULL
  WHEN {t} LIKE '[%' AND {t} LIKE '%]' AND (SELECT len(e) > 0 AND {elem_ok} FROM (SELECT {elems} AS e)) IS TRUE
       THEN (SELECT {elem_val} FROM (SELECT {elems} AS e))
  WHEN len({nums}) > 0 THEN list_transform({nums}, lambda x: {to_float("TRY_CAST(x AS DOUBLE)")})
  ELSE NULL END)"""


CRAWL = """
crawl0 AS (
  SELECT p.page_id AS pos,
    regexp_extract(s.url, '^https?://[^/]+/([a-z]+)/', 1) AS code,
    CASE WHEN p.page_id % 41 = 40 THEN ''
         ELSE regexp_replace(s.url, '/[0-9]+', concat('/p', CAST(s.page_id % 97 AS VARCHAR)), 'g') END AS url,
    CASE WHEN p.page_id % 29 = 28 THEN '404' ELSE '200' END AS status,
    CASE WHEN p.page_id % 31 = 30 THEN 'Non-Indexable' ELSE 'Indexable' END AS indexability,
    CASE WHEN p.page_id % 37 = 36 THEN 'short' WHEN p.page_id % 43 = 42 THEN 'zero'
         WHEN p.page_id % 47 = 46 OR e.vec_id IS NULL THEN 'none' ELSE 'ok' END AS vec_kind,
    e.embedding AS emb0
  FROM pages p
  JOIN pages s ON s.page_id = CASE WHEN p.page_id % 19 = 18 THEN p.page_id - 4 ELSE p.page_id END
  LEFT JOIN embeddings e ON e.vec_id = p.page_id),
crawl AS (
  SELECT pos, code, url, status, indexability, vec_kind,
    CASE vec_kind WHEN 'ok' THEN emb0 WHEN 'short' THEN emb0[1:32]
         WHEN 'zero' THEN list_transform(range(64), lambda i: 0.0::FLOAT) ELSE NULL END AS embedding
  FROM crawl0)"""


def _row_filter_cte() -> str:
    st = f"TRY_CAST(trunc(TRY_CAST({trim('status')} AS DOUBLE)) AS BIGINT)"
    idx = f"lower({trim('indexability')})"
    return f"""
rf AS (
  SELECT code, pos, {trim("coalesce(url, '')")} AS url, embedding,
    CASE WHEN {trim("coalesce(url, '')")} = '' THEN 'leere URL'
         WHEN {st} IS NULL THEN 'Status Code'
         WHEN {st} <> 200 THEN 'Status Code ' || CAST({st} AS VARCHAR)
         WHEN NOT coalesce(starts_with({idx}, 'indexable') OR starts_with({idx}, 'indexierbar'), false)
              THEN 'nicht indexierbar (' || coalesce(indexability, 'nan') || ')'
    END AS r1
  FROM crawl)"""


def _sets_ctes() -> str:
    return CRAWL + "," + _row_filter_cte() + """,
st2 AS (
  SELECT *, CASE WHEN r1 IS NOT NULL THEN NULL WHEN embedding IS NULL THEN 'Embedding fehlt'
                 WHEN len(embedding) = 0 THEN 'Embedding nicht lesbar' END AS r2
  FROM rf),""" + sets_tail()


def sets_tail() -> str:
    """Set building from ``st2(code, pos, url, embedding, r1, r2)`` on: ``valid`` and ``dropped``."""
    nu_sql, _ = norm_url_ctes("rows0", "url", "rowsn")
    return f"""
rows0 AS (
  SELECT code, pos, url, list_transform(embedding, lambda x: coalesce(x, 'NaN'::FLOAT)) AS vec
  FROM st2 WHERE r1 IS NULL AND r2 IS NULL),
{nu_sql},
rows1 AS (
  SELECT *, len(vec) AS n, list_reduce(list_transform(vec, lambda x: x::DOUBLE * x::DOUBLE), lambda a, b: a + b) AS sumsq
  FROM rowsn),
dimcnt AS (SELECT code, n, count(*) AS cnt FROM rows1 GROUP BY code, n),
dims AS (SELECT code, n AS dim FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY cnt DESC, n DESC) AS r FROM dimcnt) WHERE r = 1),
rows2 AS (
  SELECT r.*, d.dim, r.n = d.dim AS dim_ok,
    (r.sumsq IS NULL OR isnan(r.sumsq) OR r.sumsq < 1.401298464324817e-45 OR r.sumsq > 3.4028234663852886e38) AS bad_norm
  FROM rows1 r JOIN dims d USING (code)),
owners AS (
  SELECT code, norm_url, min(pos) AS opos, arg_min(url, pos) AS ourl FROM rows2 WHERE dim_ok AND NOT bad_norm
  GROUP BY code, norm_url),
rows3 AS (
  SELECT r.*, o.opos, o.ourl,
    CASE WHEN NOT r.dim_ok THEN 'Dimension ' || r.n || ' statt ' || r.dim || ' (vermutlich abgeschnitten)'
         WHEN o.opos < r.pos THEN 'Duplikat nach Normalisierung von ' || o.ourl
         WHEN r.bad_norm THEN 'Nullvektor oder ungültige Werte' END AS r3
  FROM rows2 r LEFT JOIN owners o USING (code, norm_url)),
valid AS (
  SELECT code, pos, url, norm_url, list_transform(vec, lambda x: (x::DOUBLE / sqrt(sumsq))::FLOAT) AS vec
  FROM rows3 WHERE r3 IS NULL),
dropped AS (
  SELECT code, pos, 1::BIGINT AS stage, url, r1 AS reason FROM st2 WHERE r1 IS NOT NULL
  UNION ALL SELECT code, pos, 2::BIGINT, url, r2 FROM st2 WHERE r2 IS NOT NULL
  UNION ALL SELECT code, pos, 3::BIGINT, url, r3 FROM rows3 WHERE r3 IS NOT NULL)"""


def _match_ctes(x_default: str = PIVOT) -> str:
    okey = strip_language("norm_url", "code")
    pkey = strip_language("norm_url", f"'{PIVOT}'")
    return _sets_ctes() + f""",
piv AS (SELECT pos AS a, url AS pivot_url, norm_url, vec FROM valid WHERE code = '{PIVOT}'),
oth AS (SELECT code, pos AS b, url AS other_url, norm_url, vec FROM valid WHERE code <> '{PIVOT}'),
codes AS (SELECT DISTINCT code FROM oth),
okey AS (SELECT code, {okey} AS key, min(b) AS b FROM oth GROUP BY ALL),
pkey AS (SELECT {pkey} AS key, min(a) AS a FROM piv GROUP BY ALL),
slug AS (SELECT o.code, p.a, o.b FROM okey o JOIN pkey p ON o.key = p.key),
remp AS (SELECT c.code, p.a, p.vec FROM piv p CROSS JOIN codes c
         WHERE NOT EXISTS (SELECT 1 FROM slug s WHERE s.code = c.code AND s.a = p.a)),
remo AS (SELECT o.code, o.b, o.vec FROM oth o WHERE NOT EXISTS (SELECT 1 FROM slug s WHERE s.code = o.code AND s.b = o.b)),
pairs AS (SELECT p.code, p.a, o.b, round(list_dot_product(p.vec::DOUBLE[], o.vec::DOUBLE[]), 10) AS score
          FROM remp p JOIN remo o ON p.code = o.code),
topk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY code, a ORDER BY score DESC, b) AS rank FROM pairs)
         WHERE rank <= {K}),
best AS (SELECT code, b, a, score FROM (SELECT *, row_number() OVER (PARTITION BY code, b ORDER BY score DESC, a) AS r FROM pairs)
         WHERE r = 1),
cand AS (SELECT code, a, b, score, row_number() OVER (PARTITION BY code ORDER BY score DESC, a, b) AS rn
         FROM topk WHERE score >= {THRESHOLD}),
walk(code, rn, used_a, used_b, took) AS (
  SELECT code, 0::BIGINT, []::BIGINT[], []::BIGINT[], false FROM codes
  UNION ALL
  SELECT w.code, c.rn,
    CASE WHEN list_contains(w.used_a, c.a) OR list_contains(w.used_b, c.b) THEN w.used_a ELSE list_append(w.used_a, c.a) END,
    CASE WHEN list_contains(w.used_a, c.a) OR list_contains(w.used_b, c.b) THEN w.used_b ELSE list_append(w.used_b, c.b) END,
    NOT (list_contains(w.used_a, c.a) OR list_contains(w.used_b, c.b))
  FROM walk w JOIN cand c ON c.code = w.code AND c.rn = w.rn + 1),
assigned AS (SELECT c.code, c.a, c.b, c.score FROM walk w JOIN cand c ON c.code = w.code AND c.rn = w.rn WHERE w.took),
rank1 AS (SELECT code, a, b AS b1 FROM topk WHERE rank = 1),
second AS (SELECT t.code, t.a, arg_min(t.b, t.rank) AS sb, arg_min(t.score, t.rank) AS sscore
           FROM topk t JOIN assigned x ON t.code = x.code AND t.a = x.a WHERE t.b <> x.b GROUP BY t.code, t.a),
em AS (
  SELECT x.code, x.a AS pivot_pos, x.b AS other_pos, x.score AS raw,
    coalesce(r.b1 = x.b AND bp.a = x.a, false) AS reciprocal,
    s.sb AS second_pos, s.sscore, x.score - s.sscore AS rmargin,
    CASE WHEN bp.a <> x.a THEN bp.a END AS preferred_pos,
    CASE WHEN bp.a <> x.a THEN round(bp.score, 4) END AS preferred_pivot_score
  FROM assigned x LEFT JOIN rank1 r ON r.code = x.code AND r.a = x.a
  LEFT JOIN best bp ON bp.code = x.code AND bp.b = x.b
  LEFT JOIN second s ON s.code = x.code AND s.a = x.a),
em2 AS (
  SELECT *, concat_ws('; ',
      CASE WHEN raw < {THRESHOLD} + {BAND} THEN printf('knapp über Threshold (%.3f)', raw) END,
      CASE WHEN NOT reciprocal THEN 'nicht reziprok' END,
      CASE WHEN rmargin < {MARGIN} THEN printf('mehrdeutig (Margin %.3f)', rmargin) END) AS reason
  FROM em),
core AS (
  SELECT code, a AS pivot_pos, b AS other_pos, 1.0::DOUBLE AS score, 'slug' AS method, true AS reciprocal,
    NULL::BIGINT AS second_pos, NULL::DOUBLE AS second_score, NULL::DOUBLE AS margin, 'sicher' AS confidence,
    '' AS reason, NULL::BIGINT AS preferred_pos, NULL::DOUBLE AS preferred_pivot_score
  FROM slug
  UNION ALL
  SELECT code, pivot_pos, other_pos, round(raw, 4), 'embedding', reciprocal, second_pos, round(sscore, 4), round(rmargin, 4),
    CASE WHEN reason = '' THEN 'sicher' ELSE 'prüfen' END, reason, preferred_pos, preferred_pivot_score
  FROM em2),
matches AS (
  SELECT c.code, c.pivot_pos, c.other_pos, p.pivot_url, o.other_url, c.score, c.method, c.reciprocal,
    o2.other_url AS second_url, c.second_score, c.margin, c.confidence, c.reason,
    p2.pivot_url AS preferred_pivot_url, c.preferred_pivot_score
  FROM core c
  LEFT JOIN piv p ON p.a = c.pivot_pos
  LEFT JOIN oth o ON o.code = c.code AND o.b = c.other_pos
  LEFT JOIN oth o2 ON o2.code = c.code AND o2.b = c.second_pos
  LEFT JOIN piv p2 ON p2.a = c.preferred_pos),
unm AS (
  SELECT o.code, o.b AS pos, o.other_url AS url FROM oth o
  WHERE NOT EXISTS (SELECT 1 FROM matches m WHERE m.code = o.code AND m.other_pos = o.b)
  UNION ALL
  SELECT '{PIVOT}', p.a, p.pivot_url FROM piv p WHERE NOT EXISTS (SELECT 1 FROM matches m WHERE m.pivot_pos = p.a)),
clus AS (
  SELECT p.a AS pivot_pos, p.pivot_url, count(m.code) AS n_matches, coalesce(list(m.code), []) AS others,
    coalesce(bool_or(m.confidence = 'prüfen'), false) AS any_review
  FROM piv p LEFT JOIN matches m ON m.pivot_pos = p.a GROUP BY p.a, p.pivot_url),
grid AS (
  SELECT c.pivot_pos, c.pivot_url, k.code, k.code_rank, c.n_matches, c.any_review, m.other_url, m.score, m.method,
    m.confidence AS m_conf, m.reason, m.second_url, m.second_score, m.preferred_pivot_url, m.preferred_pivot_score,
    CASE WHEN c.n_matches > 0 THEN CASE WHEN c.any_review THEN 'prüfen' ELSE 'sicher' END ELSE 'kein Treffer' END AS cluster_conf,
    CASE WHEN 1 + c.n_matches >= 2 AND NOT list_contains(list_append(c.others, '{PIVOT}'), '{x_default}') THEN 'ja' ELSE 'nein' END AS fallback
  FROM clus c CROSS JOIN (SELECT code, (row_number() OVER (ORDER BY code)) - 1 AS code_rank FROM codes) k
  LEFT JOIN matches m ON m.pivot_pos = c.pivot_pos AND m.code = k.code)"""


def _esc(x: str) -> str:
    return (f"replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), "
            f"'\"', '&quot;'), '''', '&#x27;')")


def _tag(code: str, url: str) -> str:
    return f"""('<link rel="alternate" hreflang="' || {code} || '" href="' || {_esc(url)} || '" />')"""


def _sql(ctes: str, select: str) -> str:
    return "WITH RECURSIVE " + ctes.strip() + "\n" + select


def oracle_sql() -> dict[str, str]:
    nu_pages, _ = norm_url_ctes("pg", "url", "pgn")
    nu_crawl, _ = norm_url_ctes("cw", "url", "cwn")
    text_vec = ("'[' || array_to_string(list_transform(embedding, lambda x: CAST(x AS VARCHAR)), ', ') || ']'")
    out: dict[str, str] = {}
    out["normalize_url"] = _sql(f"pg AS (SELECT page_id, url FROM pages), {nu_pages}", "SELECT page_id, norm_url FROM pgn")
    out["slug_keys"] = _sql(
        CRAWL + f", cw AS (SELECT pos, code, url FROM crawl), {nu_crawl}",
        f"SELECT pos, code, {strip_language('norm_url', 'code')} AS slug_key FROM cwn",
    )
    digest = "CAST(len(vec) AS DOUBLE) AS n, vec[1]::DOUBLE AS first, vec[-1]::DOUBLE AS last"
    out["parse_vector"] = _sql(
        CRAWL + f", tv AS (SELECT pos, CASE WHEN embedding IS NOT NULL THEN {text_vec} END AS t FROM crawl),"
        f" pv AS (SELECT pos, {parse_vector('t')} AS vec FROM tv)",
        f"SELECT pos, {digest} FROM pv",
    )
    out["parse_vector_text"] = _sql(
        f"pv AS (SELECT doc_id, {parse_vector('text')} AS vec FROM documents)", f"SELECT doc_id, {digest} FROM pv"
    )
    out["row_filter"] = _sql(CRAWL + "," + _row_filter_cte(), "SELECT code, pos, url, r1 AS reason FROM rf")
    sets = _sets_ctes()
    out["language_set_valid"] = _sql(
        sets, "SELECT code, pos, url, norm_url, CAST(len(vec) AS BIGINT) AS dim, round(vec[1]::DOUBLE, 6) AS v0 FROM valid"
    )
    out["language_set_dropped"] = _sql(sets, "SELECT code, pos, stage, url, reason FROM dropped")
    out["majority_dim"] = _sql(
        CRAWL + "," + _row_filter_cte() + """,
c AS (SELECT code, len(embedding) AS n FROM rf WHERE r1 IS NULL AND embedding IS NOT NULL AND len(embedding) > 0),
cnt AS (SELECT code, n, count(*) AS cnt FROM c GROUP BY code, n)""",
        "SELECT code, CAST(n AS BIGINT) AS dim FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY cnt DESC, n DESC) AS r FROM cnt) WHERE r = 1",
    )
    out["set_metrics"] = _sql(sets, """
SELECT coalesce(v.code, d.code) AS code, coalesce(v.valid_rows, 0) AS valid_rows, v.dim,
       coalesce(d.dropped_rows, 0) AS dropped_rows
FROM (SELECT code, count(*) AS valid_rows, CAST(max(len(vec)) AS BIGINT) AS dim FROM valid GROUP BY code) v
FULL OUTER JOIN (SELECT code, count(*) AS dropped_rows FROM dropped GROUP BY code) d ON v.code = d.code""")
    m = _match_ctes()
    out["slug_match"] = _sql(m, "SELECT code, a AS pivot_pos, b AS other_pos FROM slug")
    out["topk_similarity"] = _sql(m, "SELECT code, a, b, CAST(rank AS BIGINT) AS rank, round(score, 4) AS score FROM topk")
    out["best_pivot"] = _sql(m, "SELECT code, b, a, round(score, 4) AS score FROM best")
    out["reciprocal_pairs"] = _sql(
        m, "SELECT t.code, t.a, t.b FROM topk t JOIN best x ON x.code = t.code AND x.b = t.b AND x.a = t.a WHERE t.rank = 1"
    )
    out["greedy_assignment"] = _sql(m, "SELECT code, a, b, round(score, 4) AS score FROM assigned")
    out["matches"] = _sql(m, "SELECT * FROM matches")
    out["match_stats"] = _sql(m, f"""
SELECT v.code,
  CASE WHEN v.code = '{PIVOT}' THEN NULL ELSE coalesce(s.slug, 0) END::DOUBLE AS slug,
  CASE WHEN v.code = '{PIVOT}' THEN NULL ELSE coalesce(s.embedding, 0) END::DOUBLE AS embedding,
  CASE WHEN v.code = '{PIVOT}' THEN NULL ELSE coalesce(s.sicher, 0) END::DOUBLE AS sicher,
  CASE WHEN v.code = '{PIVOT}' THEN NULL ELSE coalesce(s.pruefen, 0) END::DOUBLE AS pruefen,
  coalesce(u.unmatched, 0)::DOUBLE AS unmatched,
  (CASE WHEN v.code = '{PIVOT}' THEN v.n END)::DOUBLE AS total
FROM (SELECT code, count(*) AS n FROM valid GROUP BY code) v
LEFT JOIN (SELECT code, count(*) FILTER (WHERE method = 'slug') AS slug, count(*) FILTER (WHERE method = 'embedding') AS embedding,
                  count(*) FILTER (WHERE confidence = 'sicher') AS sicher, count(*) FILTER (WHERE confidence = 'prüfen') AS pruefen
           FROM matches GROUP BY code) s ON s.code = v.code
LEFT JOIN (SELECT code, count(*) AS unmatched FROM unm GROUP BY code) u ON u.code = v.code""")
    out["unmatched"] = _sql(m, """
SELECT code AS "Sprache", url AS "URL", reason AS "Grund" FROM dropped
UNION ALL SELECT code, url, 'kein Treffer über Threshold' FROM unm""")
    out["clusters"] = _sql(m, f"""
SELECT c.pivot_pos, c.pivot_url, e.members, 1 + c.n_matches AS n_members,
       CASE WHEN c.any_review THEN 'prüfen' ELSE 'sicher' END AS confidence
FROM clus c JOIN (
  SELECT pivot_pos, string_agg(entry, ' | ' ORDER BY entry) AS members FROM (
    SELECT a AS pivot_pos, '{PIVOT}=' || pivot_url AS entry FROM piv
    UNION ALL SELECT pivot_pos, code || '=' || other_url FROM matches) GROUP BY pivot_pos) e USING (pivot_pos)""")
    out["cluster_counts"] = _sql(m, """
SELECT count(*) FILTER (WHERE n_matches >= 1) AS clusters,
       count(*) FILTER (WHERE n_matches >= 1 AND any_review) AS review FROM clus""")
    long_cols = f"""pivot_url AS "Pivot-URL ({PIVOT})", code AS "Sprache", coalesce(other_url, '') AS "URL", score AS "Score",
  coalesce(method, '') AS "Methode", coalesce(m_conf, '') AS "Konfidenz", coalesce(reason, '') AS "Grund",
  coalesce(second_url, '') AS "Zweitbeste URL", second_score AS "Zweitbester Score",
  coalesce(preferred_pivot_url, '') AS "Bevorzugte Pivot-URL", preferred_pivot_score AS "Score bevorzugte Pivot-URL",
  cluster_conf AS "Cluster-Konfidenz", fallback AS "x-default-Fallback" """
    out["mapping_long"] = _sql(m, f"SELECT {long_cols} FROM grid")
    out["mapping_lean"] = _sql(
        m, f"""SELECT pivot_url AS "Pivot-URL ({PIVOT})", code AS "Sprache", coalesce(other_url, '') AS "URL", score AS "Score" FROM grid"""
    )
    wide_fields = [
        ("URL", "coalesce(other_url, '')"), ("Score", "score"), ("Methode", "coalesce(method, '')"),
        ("Konfidenz", "coalesce(m_conf, '')"), ("Grund", "coalesce(reason, '')"),
        ("Zweitbeste URL", "coalesce(second_url, '')"), ("Zweitbester Score", "second_score"),
        ("Bevorzugte Pivot-URL", "coalesce(preferred_pivot_url, '')"),
        ("Score bevorzugte Pivot-URL", "preferred_pivot_score"),
    ]
    wide_cols = ",\n  ".join(
        f"""max(CASE WHEN code = '{c}' THEN {expr} END) AS "{name} ({c})" """ for c in OTHER_CODES for name, expr in wide_fields
    )
    out["mapping_wide"] = _sql(m, f"""
SELECT pivot_url AS "Pivot-URL ({PIVOT})",
  {wide_cols},
  cluster_conf AS "Cluster-Konfidenz", fallback AS "x-default-Fallback"
FROM grid GROUP BY pivot_pos, pivot_url, cluster_conf, fallback""")
    lang = f"lower(split_part({trim('code')}, '-', 1))"
    out["html_blocks"] = _sql(m + f""",
mem AS (
  SELECT a AS pivot_pos, '{PIVOT}' AS code, pivot_url AS url, pivot_url AS purl FROM piv
  UNION ALL SELECT m.pivot_pos, m.code, m.other_url, m.pivot_url FROM matches m),
mem2 AS (SELECT *, count(*) OVER (PARTITION BY pivot_pos) AS n_members,
           (row_number() OVER (PARTITION BY pivot_pos ORDER BY CASE WHEN code = '{PIVOT}' THEN 0 ELSE 1 END, code)) - 1 AS code_rank
         FROM mem),
tags AS (
  SELECT pivot_pos, string_agg({_tag(lang, 'url')}, chr(10) ORDER BY code_rank)
         || chr(10) || {_tag("'x-default'", f"max(CASE WHEN code = '{PIVOT}' THEN url END)")} AS tag_text
  FROM mem2 WHERE n_members >= 2 GROUP BY pivot_pos)""", f"""
SELECT m.pivot_pos, CAST(m.code_rank AS BIGINT) AS code_rank, m.code,
       '<!-- ' || {_esc('m.url')} || ' -->' || chr(10) || t.tag_text AS block
FROM mem2 m JOIN tags t USING (pivot_pos)""")
    out["language_collisions"] = _sql(CRAWL + f""",
cc AS (SELECT DISTINCT code FROM crawl)""", f"""
SELECT {lang} AS language, string_agg(code, ',' ORDER BY code) AS codes FROM cc GROUP BY 1 HAVING count(*) > 1""")
    from .oracle_more import oracle_sql_more
    from .oracle_output import oracle_sql_output

    out.update(oracle_sql_more())
    out.update(oracle_sql_output())
    return out
