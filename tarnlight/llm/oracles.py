"""DuckDB SQL for the contract queries that SQL can express."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_STRIP = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

_OP7 = f"""
WITH lines AS (
  SELECT doc_id, i, l, translate(trim(l, {_STRIP}), '{_UPPER}', '{_LOWER}') AS k
  FROM (SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
dup AS (
  SELECT k, max(doc_id) AS top FROM lines WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT lines.*, dup.k IS NOT NULL AND lines.doc_id <> dup.top AS gone FROM lines LEFT JOIN dup ON lines.k = dup.k)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INT)) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""

_WORD = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_OP1 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), {_WORD}) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), {_WORD}) AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(len(w), 13) AS m, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS g
       FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m)),
hit AS (SELECT doc_id, item_id, i, dw.m FROM dw JOIN bw ON dw.g = bw.g AND dw.m = bw.m),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ks
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ks, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""

_OP10 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 75 * (p.n + q.n - k)),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
m AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN m ON m.x = d.doc_id"""

_OP2 = f"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), {_WORD}) AS w FROM documents),
g AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(w[i + 1:i + 50], ' ')) AS h
     FROM (SELECT doc_id, w, unnest(range(0, len(w) - 49)) AS i FROM d WHERE len(w) >= 50)),
two AS (SELECT h, min(doc_id) AS lo FROM g GROUP BY h HAVING count(DISTINCT doc_id) > 1),
snd AS (SELECT g.h, min(doc_id) AS nx FROM g JOIN two ON g.h = two.h AND g.doc_id <> two.lo GROUP BY g.h),
hit AS MATERIALIZED (SELECT g.doc_id, g.i, CASE WHEN g.doc_id = two.lo THEN snd.nx ELSE two.lo END AS other
        FROM g JOIN two ON g.h = two.h JOIN snd ON g.h = snd.h),
edge AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS fresh FROM hit),
runs AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM edge),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM runs GROUP BY doc_id, k),
per AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n, string_agg(a || ':' || b, ',' ORDER BY a) AS ss FROM spans GROUP BY doc_id),
o AS (SELECT doc_id, min(other) AS other_id FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(per.n, 0) AS n_repeated, o.other_id, coalesce(per.ss, '') AS spans
FROM d LEFT JOIN per USING (doc_id) LEFT JOIN o USING (doc_id)"""

# personal data: the same patterns with word boundaries for the look-arounds
_PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}\b",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "tel": r"\b[0-9]{3}[\x20.-][0-9]{3}[\x20.-][0-9]{4}\b",
}
_PII_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.35, "tel": 0.3}
_CALL = "phone|call|tel|fax|mobile|telefon|téléphone|teléfono"
_PII_WORDS = {"email": "mail", "ip": "ip", "card": "card", "phone": _CALL, "iban": "iban|account|bank|konto|compte|cuenta", "ssn": "ssn|social security|tax id", "tel": _CALL}
_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"""list_sum([CASE WHEN (length({_DIGITS}) - i) % 2 = 0 THEN CAST(substr({_DIGITS}, i, 1) AS INT)
  WHEN CAST(substr({_DIGITS}, i, 1) AS INT) > 4 THEN 2 * CAST(substr({_DIGITS}, i, 1) AS INT) - 9 ELSE 2 * CAST(substr({_DIGITS}, i, 1) AS INT) END
  FOR i IN range(1, length({_DIGITS}) + 1)]) % 10 = 0"""
_TURNED = "substr(replace(m, ' ', ''), 5) || substr(replace(m, ' ', ''), 1, 4)"
_MOD97 = f"""list_reduce([CAST(unicode(substr({_TURNED}, i, 1)) AS BIGINT) FOR i IN range(1, length({_TURNED}) + 1)],
  lambda a, c: CASE WHEN c < 58 THEN (a * 10 + c - 48) % 97 ELSE (a * 100 + c - 55) % 97 END, CAST(0 AS BIGINT)) = 1"""
_PII_CHECK = {
    "email": "true",
    "ip": "len(list_filter([ltrim(x, '0') FOR x IN string_split(m, '.')], lambda x: length(x) > 3 OR coalesce(try_cast(x AS INT), 0) > 255)) = 0",
    "card": f"CASE WHEN length({_DIGITS}) BETWEEN 13 AND 19 THEN {_LUHN} ELSE false END",
    "phone": f"length({_DIGITS}) BETWEEN 9 AND 15",
    "iban": _MOD97,
    "ssn": "substr(m, 1, 3) NOT IN ('000', '666') AND substr(m, 5, 2) <> '00' AND substr(m, 8, 4) <> '0000'",
    "tel": "true",
}


def _pii_kind(rank: int, kind: str) -> str:
    near = "lower(substr(t, greatest(1, s + 1 - 48), least(s, 48)) || ' ' || substr(t, e + 1, 24))"
    return f"""SELECT doc_id, {rank} AS r, '{kind}' AS k, s, e,
  round({_PII_SCORE[kind]} + CASE WHEN regexp_matches({near}, '(?:^|[^a-z])(?:{_PII_WORDS[kind]})') THEN 0.3 ELSE 0 END, 2) AS score
FROM (SELECT doc_id, t, m, CAST(sum(length(p)) OVER w + sum(length(m)) OVER w - length(m) AS BIGINT) AS s, CAST(sum(length(p)) OVER w + sum(length(m)) OVER w AS BIGINT) AS e
      FROM (SELECT doc_id, t, unnest(ms) AS m, unnest(ps[1:len(ms)]) AS p, generate_subscripts(ms, 1) AS i
            FROM (SELECT doc_id, t, regexp_extract_all(t, '{_PII[kind]}') AS ms, string_split_regex(t, '{_PII[kind]}') AS ps FROM d) WHERE len(ms) > 0)
      WINDOW w AS (PARTITION BY doc_id ORDER BY i)) WHERE {_PII_CHECK[kind]}"""


_BASE_KINDS = ("email", "ip", "card", "phone")
_OP3 = f"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t FROM documents),
b AS MATERIALIZED ({" UNION ALL ".join(_pii_kind(i, k) for i, k in enumerate(_PII) if k in _BASE_KINDS)}),
m AS ({" UNION ALL ".join(_pii_kind(i, k) for i, k in enumerate(_PII) if k not in _BASE_KINDS)}),
a AS (SELECT * FROM b UNION ALL SELECT * FROM m WHERE score >= 0.5 AND NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = m.doc_id AND b.s < m.e AND m.s < b.e)),
g AS (SELECT doc_id, {", ".join(f"count(*) FILTER (WHERE k = '{k}') AS n_{k}" for k in _BASE_KINDS)},
  string_agg(k || ':' || s || ':' || e, ',' ORDER BY r, s) FILTER (WHERE r < 4) AS bs, string_agg(k || ':' || s || ':' || e, ',' ORDER BY r, s) AS spans FROM a GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in _BASE_KINDS)}, sha256(coalesce(bs, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)"""

ORACLES = {"op3_pii": _OP3, "op2_suffix_dedup": _OP2, "op10_jaccard_join": _OP10, "op1_decontam": _OP1, "op7_line_dedup": _OP7}
