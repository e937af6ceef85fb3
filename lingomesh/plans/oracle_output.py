"""DuckDB twins of the queries in ``queries_output``."""

from __future__ import annotations

from . import oracle as O
from . import oracle_more as M

OTHER = "fr"


def oracle_sql_output() -> dict[str, str]:
    m, other = O._match_ctes(), O._match_ctes(OTHER)
    more = M.oracle_sql_more()
    members = f""",
mem AS (
  SELECT a AS pivot_pos, '{O.PIVOT}' AS code, pivot_url AS url, pivot_url AS purl FROM piv
  UNION ALL SELECT m.pivot_pos, m.code, m.other_url, m.pivot_url FROM matches m),
mem2 AS (SELECT mem.*, any_review, count(*) OVER (PARTITION BY mem.pivot_pos) AS n_members,
           (row_number() OVER (PARTITION BY mem.pivot_pos ORDER BY CASE WHEN code = '{O.PIVOT}' THEN 0 ELSE 1 END, code)) - 1 AS code_rank
         FROM mem JOIN clus USING (pivot_pos))"""
    tags = f""",
tags AS (
  SELECT pivot_pos, string_agg({O._tag('code', 'url')}, chr(10) ORDER BY code_rank) || chr(10)
         || {O._tag("'x-default'", f"coalesce(max(CASE WHEN code = '{OTHER}' THEN url END), max(purl))")} AS tag_text
  FROM mem2 WHERE n_members >= 2 AND NOT any_review GROUP BY pivot_pos)"""
    blank = {k: more[k.replace("blank_", "text_sets_").replace("text_sets_texts_", "text_sets_")].replace(
        "FROM docs)", "FROM (SELECT * REPLACE (CASE WHEN pos % 7 = 3 THEN '' ELSE text END AS text) FROM docs))") for k in ("blank_texts_valid", "blank_texts_dropped")}
    return {
        "mapping_long_order": O._sql(m, """SELECT row_number() OVER (ORDER BY pivot_pos, code_rank) - 1 AS ord, pivot_pos, code AS "Sprache",
  coalesce(other_url, '') AS "URL" FROM grid"""),
        "html_blocks_order": O._sql(m + members, """SELECT row_number() OVER (ORDER BY pivot_pos, code_rank) - 1 AS ord, pivot_pos, code
FROM mem2 WHERE n_members >= 2"""),
        "suggest_patterns_order": f"""SELECT row_number() OVER (ORDER BY count DESC, pattern) - 1 AS ord, pattern, code, count
FROM ({more['suggest_patterns']})""",
        "x_default_other": O._sql(other, "SELECT pivot_pos, code, fallback FROM grid"),
        "html_review_off": O._sql(m + members + tags, f"""SELECT m.pivot_pos, CAST(m.code_rank AS BIGINT) AS code_rank, m.code,
       '<!-- ' || {O._esc('m.url')} || ' -->' || chr(10) || t.tag_text AS block
FROM mem2 m JOIN tags t USING (pivot_pos)"""),
        "region_collisions": O._sql(O.CRAWL, """SELECT language, string_agg(code, ',' ORDER BY code) AS codes FROM (
  SELECT DISTINCT code AS language, code || CASE WHEN pos % 3 = 0 THEN '-AT' WHEN pos % 3 = 1 AND code <> 'es' THEN '-ch' ELSE '' END AS code
  FROM crawl WHERE code <> 'es' OR pos % 3 <> 0) GROUP BY language HAVING count(*) > 1"""),
        "blank_texts_valid": f"SELECT code, pos, url, v0 FROM ({blank['blank_texts_valid']})",
        "blank_texts_dropped": blank["blank_texts_dropped"],
        "detect_columns": f"""WITH c AS ({more['csv_scan']}), k AS (SELECT count(address) AS a, count(numbers) AS e, count(status) AS s, count(title) AS t FROM c)
SELECT 'url' AS role, 'Address' AS "column", a AS filled FROM k UNION ALL SELECT 'embedding', 'Embedding', e FROM k
UNION ALL SELECT 'status', 'Status Code', s FROM k UNION ALL SELECT 'indexability', NULL, 0 FROM k UNION ALL SELECT 'text', 'Title', t FROM k""",
    }
