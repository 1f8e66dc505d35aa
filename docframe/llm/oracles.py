"""DuckDB SQL for the queries whose whole result SQL can express; written without the operators' own helpers."""

from __future__ import annotations

import string

from . import licenses
from .notices import NOTICES

_WORD = r"'[^\x20\x09-\x0D]+'"
_LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"


def near_duplicates(words: int = 4, percent: int = 80) -> str:
    """Shingle sets, all pairs that share a shingle, and the closure of the links."""
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_WORD}) AS w FROM documents),
listed AS (
  SELECT doc_id, unnest(CASE WHEN len(w) >= {words} THEN list_transform(range(1, len(w) - {words - 2}), lambda i: array_to_string(w[i:i + {words - 1}], ' '))
                             WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
sh AS (SELECT DISTINCT doc_id, s FROM listed),
sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared.n >= {percent} * (x.n + y.n - shared.n)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS node, b AS other FROM both_ways UNION SELECT reach.node, both_ways.b FROM reach JOIN both_ways ON reach.other = both_ways.a),
roots AS (SELECT node, least(node, min(other)) AS root FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(r.root, d.doc_id) AS component_id, coalesce(r.root, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN roots r ON r.node = d.doc_id"""


QUALITY_BASE = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT doc_id, text, regexp_extract_all(text, {_WORD}) AS w,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w),
windows AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM starts),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM windows WHERE n > 1) GROUP BY doc_id),
base AS (
  SELECT w.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
  FROM w LEFT JOIN covered ON covered.doc_id = w.doc_id)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base"""

#: Kind, expression, group and least length of that group (fixed values; the letters of the first in either case).
_ANY_CASE = {x: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in x) for x in ("password", "passwd", "secret", "token", "api_?key")}
_KINDS = [
    ("assign", rf"({'|'.join(_ANY_CASE.values())})[\"\x27]?\x20*[:=]\x20*[\"\x27]?([A-Za-z0-9+/_.=-]+)", 2, 12),
    ("access", "AKIA[A-Z0-9]+", 0, 18),
    ("hex", "[0-9a-f]+", 0, 16),
    ("session", "ASIA[A-Z0-9]+", 0, 18),
    ("github", "gh[pousr]_[A-Za-z0-9]+", 0, 40),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
    ("chat", "xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    ("google", "AIza[A-Za-z0-9_-]+", 0, 39),
    ("private", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
]


def secrets() -> str:
    """Each kind's places are the lengths of what stands between its matches and of the matches before."""
    kinds = " UNION ALL ".join(
        f"SELECT doc_id, {k} AS k, '{kind}' AS kind, regexp_extract_all(text, '{p}') AS m, regexp_extract_all(text, '{p}', {g}) AS own, regexp_split_to_array(text, '{p}') AS gaps, {least} AS least FROM t"
        for k, (kind, p, g, least) in enumerate(_KINDS)
    )
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
found AS ({kinds}),
each AS (SELECT doc_id, k, kind, least, m[i] AS m, own[i] AS own, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS a
         FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM found)),
spans AS (SELECT doc_id, k, kind, CAST(a AS BIGINT) AS a, concat(kind, ':', CAST(a AS BIGINT), ':', CAST(a AS BIGINT) + length(m)) AS span FROM each WHERE length(own) >= least),
per AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
               string_agg(span, ',' ORDER BY a, k) FILTER (k < 3) AS base, string_agg(span, ',' ORDER BY a, k) AS spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN per ON per.doc_id = d.doc_id"""


def licences() -> str:
    """Windows of words joined with the weights' and the templates' tables; the weights are trained when this is called."""
    names, weights, bias, _ = licenses.train()
    rows = ", ".join(f"('{g}', {k}, {licenses.shown(float(v))})" for g, own in sorted(weights.items()) for k, v in enumerate(own))
    biases = ", ".join(f"({k}, '{name}', {licenses.shown(float(v))})" for k, (name, v) in enumerate(zip(names, bias)))
    pieces = ", ".join(f"({i}, {k}, {len(t)}, '{b}')" for i, (k, t) in enumerate(licenses.templates()) for b in t)
    step, width, least, share = licenses.STEP, licenses.WIDTH, licenses.PROBABILITY, licenses.CONTAINED
    return rf"""
WITH weights(g, k, w) AS (VALUES {rows}), classes(k, name, b) AS (VALUES {biases}), pieces(id, k, n, g) AS (VALUES {pieces}),
parts AS (SELECT doc_id, paragraph, p[paragraph + 1] AS x FROM (SELECT *, unnest(range(len(p))) AS paragraph FROM (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '\r?\n[ \t\x0b\x0c\r]*\n') AS p FROM documents))),
words AS (SELECT doc_id, paragraph, regexp_extract_all(replace(lower(x), 'licenc', 'licens'), '[a-z0-9]+') AS w FROM parts),
wins AS (SELECT doc_id, paragraph, a, w[a + 1:a + {width}] AS w FROM (SELECT *, unnest(range(0, greatest(len(w) - {step + 1}, 0) + 1, {step})) AS a FROM words)),
grams AS (
  SELECT DISTINCT doc_id, paragraph, a, g, n FROM (
    SELECT doc_id, paragraph, a, unnest(w) AS g, 1 AS n FROM wins
    UNION ALL SELECT doc_id, paragraph, a, unnest(list_transform(range(1, len(w)), lambda i: concat(w[i], ' ', w[i + 1]))), 2 FROM wins
    UNION ALL SELECT doc_id, paragraph, a, unnest(list_transform(range(1, len(w) - 1), lambda i: concat(w[i], ' ', w[i + 1], ' ', w[i + 2]))), 3 FROM wins)),
sums AS (SELECT doc_id, paragraph, a, k, sum(w) AS s FROM grams JOIN weights USING (g) GROUP BY ALL),
probable AS (SELECT doc_id, paragraph, a, k, name, 1 / (1 + exp(-(b + s))) AS p FROM sums JOIN classes USING (k)),
held AS (SELECT doc_id, paragraph, a, pieces.k, id, count(*) / any_value(pieces.n) AS c FROM grams JOIN pieces ON grams.g = pieces.g AND grams.n = 2 GROUP BY ALL),
best AS (SELECT doc_id, paragraph, a, k, max(c) AS c FROM held GROUP BY ALL),
judged AS (
  SELECT p.*, coalesce(c, 0) AS c FROM probable p LEFT JOIN best b ON b.doc_id = p.doc_id AND b.paragraph = p.paragraph AND b.a = p.a AND b.k = p.k AND p.p >= {least} AND p.k < {len(NOTICES)}),
windows AS (SELECT doc_id, paragraph, a, bool_or(k < {len(NOTICES)} AND p >= {least} AND c >= {share}) AS sure, max(p) AS p, max(c) AS c FROM judged GROUP BY ALL),
found AS (
  SELECT doc_id, paragraph, name AS family, p, c FROM judged WHERE k < {len(NOTICES)} AND p >= {least} AND c >= {share}
  UNION ALL SELECT doc_id, paragraph, '{licenses.UNKNOWN}', p, c FROM windows WHERE NOT sure AND p >= {least}),
surest AS (
  SELECT doc_id, paragraph, family, CAST(round(round(max(p), 6) * 10000) AS BIGINT) AS p FROM found f
  WHERE family <> '{licenses.UNKNOWN}' OR NOT EXISTS (SELECT 1 FROM found o WHERE o.doc_id = f.doc_id AND o.paragraph = f.paragraph AND o.family <> '{licenses.UNKNOWN}') GROUP BY ALL),
per AS (
  SELECT doc_id, count(*) FILTER (family <> '{licenses.UNKNOWN}') AS n_notices, count(*) FILTER (family = '{licenses.UNKNOWN}') AS n_unknown,
         array_to_string(list_sort(list_distinct(list(family) FILTER (family <> '{licenses.UNKNOWN}'))), ',') AS families, string_agg(concat(paragraph, ':', family, ':', p), ',' ORDER BY paragraph, family) AS notices
  FROM surest GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_notices, 0) AS n_notices, coalesce(n_unknown, 0) AS n_unknown, coalesce(families, '') AS families, coalesce(notices, '') AS notices FROM documents d LEFT JOIN per USING (doc_id)"""
