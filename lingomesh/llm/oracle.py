"""DuckDB restatements of the queries that SQL can express, over whole tables."""

from __future__ import annotations

from .quality_rules import CLASSES, COMMON, LEAST_EXPECTED, MAX_CHAR_DISTANCE, MAX_COMMON_DISTANCE, MAX_WORD_DISTANCE, MIN_DOCS, MIN_WORDS, WIDE

GAP = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({text}, ''), '{GAP}'), lambda x: x <> '')"


#: the payload's SHA-1 as base32: forty bits at a time, eight characters of five bits
_B32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((('0x' || substr(h, {10 * b + 1}, 10))::BIGINT >> {35 - 5 * c}) & 31) AS INTEGER) + 1, 1)"
    for b in range(4) for c in range(8))

OP3 = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT html, min(page_id) AS first FROM p GROUP BY html)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, {_B32} AS payload_digest,
  CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM p JOIN f USING (html)"""

OP5 = f"""WITH d AS (SELECT doc_id, {_words('text')} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
firsts AS (SELECT k, min(doc_id) AS f FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN firsts USING (k) WHERE f < doc_id),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)"""

_lines = "m"
for _tag in ("<p>", "</p>", "<h1>", "</h1>"):
    _lines = f"replace({_lines}, '{_tag}', chr(10))"
_bare = f"array_to_string(list_transform(string_split('>' || replace({_lines}, '<br>', ' '), '<'), lambda x: substr(x, strpos(x, '>') + 1)), '')"
for _name, _code in (("quot", 34), ("lt", 60), ("gt", 62), ("#39", 39), ("#x27", 39), ("amp", 38)):
    _bare = f"replace({_bare}, '&{_name};', chr({_code}))"

#: the driver's pages hold their text in one article of headings and paragraphs
OP6 = f"""WITH p AS (SELECT page_id, url, split_part(split_part(coalesce(html, ''), '<article>', 2), '</article>', 1) AS m FROM pages),
t AS (SELECT page_id, url, array_to_string(list_filter(list_transform(string_split({_bare}, chr(10)),
  lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM p)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM t"""


def _distance(p: str, q: str) -> str:
    half = "CASE WHEN {a} > 0 THEN {a} * log2({a} / (({p}[i] + {q}[i]) / 2)) ELSE 0 END / 2"
    terms = " + ".join(half.format(a=f"{x}[i]", p=p, q=q) for x in (p, q))
    return f"sqrt(greatest(list_sum(list_transform(range(1, len({p}) + 1), lambda i: {terms})), 0))"


def _shares(x: str) -> str:
    return f"list_transform({x}, lambda v: v / greatest(list_sum({x}), 1))"


_RARE = [f"len(regexp_extract_all(t, '{p.replace(chr(39), chr(39) * 2)}'))" for p in CLASSES.values()]
OP7 = f"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS t, {_words('text')} AS w FROM documents),
b AS (SELECT *, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
tri AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
twice AS (SELECT doc_id, k FROM tri GROUP BY doc_id, k HAVING count(*) > 1),
rep AS (SELECT doc_id, count(*) AS n_repeat_words FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 3)) AS p FROM tri JOIN twice USING (doc_id, k)) GROUP BY doc_id),
langs AS (SELECT lang FROM d GROUP BY lang HAVING count(*) >= {MIN_DOCS}),
freq AS (SELECT lang, x, count(*) AS n FROM (SELECT lang, unnest(w) AS x FROM d JOIN langs USING (lang)) GROUP BY lang, x),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, x) AS r FROM freq QUALIFY r <= {WIDE}),
top AS (SELECT lang, list(x ORDER BY r) AS common FROM ranked WHERE r <= {COMMON} GROUP BY lang),
nw AS (SELECT doc_id, count(*) AS n_wide FROM (SELECT doc_id, lang, unnest(w) AS x FROM d) SEMI JOIN ranked USING (lang, x) GROUP BY doc_id),
share AS (SELECT lang, 1000 * coalesce(n_wide, 0) // n_words AS share FROM b JOIN top USING (lang) LEFT JOIN nw USING (doc_id) WHERE n_words >= {MIN_WORDS}),
upto AS (SELECT lang, share, count(*) OVER (PARTITION BY lang ORDER BY share) AS upto, count(*) OVER (PARTITION BY lang) AS n FROM share),
med AS (SELECT lang, min(share) / 1000 AS ref_wide FROM upto WHERE 2 * upto >= n GROUP BY lang),
h AS (SELECT b.*, common, [{', '.join(_RARE)}] AS rare,
  list_transform(range(0, {COMMON + 1}), lambda k: len(list_filter(list_transform(w, lambda x: coalesce(list_position(common, x), 0)), lambda v: v = k))) AS commons
  FROM b LEFT JOIN top USING (lang)),
c AS (SELECT *, list_concat(rare, [length(t) - word_chars, greatest(word_chars - list_sum(rare[2:]) - rare[1], 0)]) AS chars FROM h),
u AS (SELECT lang, unnest(chars) AS v, unnest(range(1, {len(CLASSES) + 3})) AS i FROM c WHERE common IS NOT NULL),
rc AS (SELECT lang, list(s ORDER BY i) AS ref FROM (SELECT lang, i, sum(v)::DOUBLE AS s FROM u GROUP BY lang, i) GROUP BY lang),
u2 AS (SELECT lang, unnest(commons) AS v, unnest(range(1, {COMMON + 2})) AS i FROM c WHERE common IS NOT NULL),
rw AS (SELECT lang, list(s ORDER BY i) AS ref2 FROM (SELECT lang, i, sum(v)::DOUBLE AS s FROM u2 GROUP BY lang, i) GROUP BY lang),
s AS (SELECT c.*, coalesce(n_repeat_words, 0) AS n_repeat_words, {_shares('chars')} AS p1, {_shares('ref')} AS q1, {_shares('commons')} AS p2, {_shares('ref2')} AS q2,
  n_words >= {MIN_WORDS} AND ref IS NOT NULL AS guard, ref_wide, coalesce(n_wide, 0) / greatest(n_words, 1) AS ws,
  [ws, 1 - ws] AS p3, [ref_wide, 1 - ref_wide] AS q3, [0, 1] AS none
  FROM c LEFT JOIN rc USING (lang) LEFT JOIN rw USING (lang) LEFT JOIN rep USING (doc_id) LEFT JOIN med USING (lang) LEFT JOIN nw USING (doc_id)),
j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  CASE WHEN guard THEN {_distance('p1', 'q1')} END AS cd, CASE WHEN guard THEN {_distance('p2', 'q2')} END AS wd,
  CASE WHEN guard AND n_words * ref_wide >= {LEAST_EXPECTED} THEN CASE WHEN ws >= ref_wide THEN 0 ELSE {_distance('p3', 'q3')} / {_distance('none', 'q3')} END END AS od FROM s)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(cd > {MAX_CHAR_DISTANCE}, false) AND NOT coalesce(wd > {MAX_WORD_DISTANCE}, false)
    AND NOT coalesce(od > {MAX_COMMON_DISTANCE}, false) AS kept, guard AS compared
FROM j"""

OP10 = f"""WITH RECURSIVE d AS (SELECT doc_id, {_words(f"translate(text, '{UPPER}', '{LOWER}')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 80 * (x.n + y.n - m)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT a, b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON e.a = r.b),
root AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN root ON root.a = doc_id"""

#: products pass 64 bits: HUGEINT holds 38 digits
OP12 = f"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS x FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(x, '[\\x20\\x09]+'), lambda v: v <> '') AS w FROM p),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
s AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM s, (VALUES (1), (2), (3)) AS size(k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, k, phrase, count(*) AS f, string_split(phrase, ' ') AS w FROM g GROUP BY lang, k, phrase HAVING count(*) >= 10),
cut AS (SELECT lang, k, phrase, f AS a, c, array_to_string(w[1:c], ' ') AS x, array_to_string(w[c + 1:], ' ') AS y FROM f, (VALUES (1), (2)) AS cuts(c) WHERE c < k),
sc AS (SELECT cut.*, l.f AS l, r.f AS r, CAST(1000000::HUGEINT * a * a // (l.f::HUGEINT * r.f) AS BIGINT) AS score
  FROM cut JOIN f l ON l.lang = cut.lang AND l.phrase = x JOIN f r ON r.lang = cut.lang AND r.phrase = y),
best AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
inner_part AS (SELECT lang, array_to_string(w[i:i + 1], ' ') AS phrase, max(f) AS most FROM (SELECT *, unnest([1, 2]) AS i FROM f WHERE k = 3) GROUP BY 1, 2),
kept AS (SELECT best.* FROM best LEFT JOIN inner_part i ON i.lang = best.lang AND i.phrase = best.phrase WHERE most IS NULL OR 100 * most < 50 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept JOIN n USING (lang) QUALIFY rank <= 2000"""


def _share13(n: str, total: str) -> str:
    return f"1 + CAST(1000000000::HUGEINT * ({n} + 1) // ({total} + v) AS BIGINT)"


OP13 = f"""WITH d AS (SELECT row_number() OVER () AS nr, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
t AS (SELECT nr, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS c FROM t GROUP BY lang, term HAVING count(DISTINCT nr) >= 3),
l AS (SELECT lang, count(*) AS v, sum(c) AS ln FROM kept GROUP BY lang),
own AS (SELECT lang, source, term, count(*) AS c FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(gn, 0) AS gn, coalesce(v, 0) AS v, ln FROM (SELECT DISTINCT lang, source FROM d)
  LEFT JOIN (SELECT lang, source, sum(c) AS gn FROM own GROUP BY ALL) USING (lang, source) LEFT JOIN l USING (lang)),
p AS (SELECT g.lang, g.source, kept.term, coalesce(own.c, 0) AS c, {_share13('coalesce(own.c, 0)', 'gn')} AS p, {_share13('kept.c', 'ln')} AS q
  FROM g JOIN kept ON kept.lang = g.lang LEFT JOIN own ON own.lang = g.lang AND own.source = g.source AND own.term = kept.term),
pv AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pv ON pv.lang = a.lang AND pv.source = a.source AND pv.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) QUALIFY part = 'pair' OR rank <= 200"""

ORACLE = {
    "op3_warc_zip": OP3, "op5_substring_dedup": OP5, "op6_template_deduction": OP6, "op7_quality_rules": OP7, "op10_ngram_join": OP10,
    "op12_phrase_collocations": OP12, "op13_source_divergence": OP13,
}
