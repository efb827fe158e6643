"""SQL for a second engine (without lookaround) that states what the native scans and the decontamination return."""

from __future__ import annotations

import math

from pagemint.llm import pii
from pagemint.llm.license_join import PHRASES, TEMPLATES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: str) -> str:
    return f"list_filter(string_split_regex(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '{WORD_GAP}'), lambda x: x <> '')"


def spans(kind: str, number: int, pattern: str, group: int, keep: str) -> str:
    """Rows (doc_id, kind, number, start, stop, value, m) of matches that pass ``keep``."""
    quoted = pattern.replace("'", "''")
    return f"""SELECT doc_id, '{kind}' AS kind, {number} AS number, start, start + length(m) AS stop, value, m FROM (
      SELECT doc_id, m[i] AS m, v[i] AS value, cast(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS bigint) AS start
      FROM (SELECT doc_id, regexp_extract_all(t, '{quoted}') AS m, regexp_extract_all(t, '{quoted}', {group}) AS v, string_split_regex(t, '{quoted}') AS g FROM texts WHERE regexp_matches(t, '{quoted}')), unnest(range(1, len(m) + 1)) r(i)) WHERE {keep}"""


TEXTS = "texts AS (SELECT doc_id, coalesce(text, '') AS t, source, lang FROM documents)"
SAID = "kind || ':' || start || ':' || stop"

SECRETS = " UNION ALL ".join(
    [
        spans("assign", 0, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, "length(value) >= 6"),
        spans("access", 1, r"AKIA[A-Z0-9]{16,}", 0, "true"),
        spans("hex", 2, r"[0-9a-f]{24,}", 0, "true"),
        spans("opaque", 3, r"[A-Za-z0-9+/_-]{32,}", 0, "regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[0-9]')"),
        spans("pem", 4, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----\s*((?:[A-Za-z-]+: [^\n]*\n\s*)*[A-Za-z0-9+/=\s]*)", 1, "length(regexp_replace(value, '\\s', '', 'g')) >= 32"),
    ]
)
OP2 = f"""WITH {TEXTS}, s AS ({SECRETS}),
  k AS (SELECT * REPLACE (CASE WHEN number = 4 THEN regexp_replace(value, '\\s', '', 'g') ELSE value END AS value) FROM s),
  o AS (SELECT value, count(DISTINCT source) AS owners, count(DISTINCT source || '/' || lang) AS repositories FROM k JOIN texts USING (doc_id) GROUP BY value),
  j AS (SELECT k.*, owners <= 1 AND repositories <= 3 AS live FROM k JOIN o USING (value)),
  d AS (SELECT doc_id, count(*) FILTER (number = 0) AS n_assign, count(*) FILTER (number = 1) AS n_access, count(*) FILTER (number = 2) AS n_hex,
    string_agg({SAID}, ',' ORDER BY start, number) FILTER (number < 3) AS base, string_agg({SAID}, ',' ORDER BY start, number) FILTER (number < 3 OR live) AS spans,
    count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied FROM j GROUP BY doc_id)
  SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
    coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied FROM texts t LEFT JOIN d USING (doc_id)"""

DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
LUHN = (
    f"list_sum(list_transform(range(length({DIGITS})), lambda i: CASE WHEN i % 2 = 0 THEN cast(substr(reverse({DIGITS}), i + 1, 1) AS int) "
    f"WHEN cast(substr(reverse({DIGITS}), i + 1, 1) AS int) > 4 THEN 2 * cast(substr(reverse({DIGITS}), i + 1, 1) AS int) - 9 "
    f"ELSE 2 * cast(substr(reverse({DIGITS}), i + 1, 1) AS int) END)) % 10 = 0"
)
PERSONAL = " UNION ALL ".join(
    [
        spans("email", 0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", 0, "true"),
        spans("ip", 1, r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", 0, "list_bool_and(list_transform(string_split(m, '.'), lambda p: length(ltrim(p, '0')) <= 3 AND coalesce(try_cast(p AS int), 999) <= 255))"),
        spans("card", 2, r"[0-9](?:[\x20-]?[0-9])+", 0, f"length({DIGITS}) BETWEEN 13 AND 19 AND {LUHN}"),
        spans("phone", 3, r"\+[0-9][\x20().0-9-]+[0-9]", 0, f"length({DIGITS}) BETWEEN 9 AND 15"),
    ]
)
BARE = "replace(m, ' ', '')"
TURNED = f"(substr({BARE}, 5) || substr({BARE}, 1, 4))"
NUMBERS = f"list_transform(string_split({TURNED}, ''), lambda c: CASE WHEN ascii(c) >= 65 THEN ascii(c) - 55 ELSE ascii(c) - 48 END)"
MOD97 = f"list_reduce(list_prepend(0, {NUMBERS}), lambda a, x: (a * CASE WHEN x > 9 THEN 100 ELSE 10 END + x) % 97) = 1"
#: IBANs of countries whose length is known; their edges are checked where the match is (no lookaround here).
IBANS = spans("iban", 4, pii.FIXED, 0, MOD97)
EDGES = "NOT regexp_matches(substr(t, start, 1), '[A-Za-z0-9]') AND NOT regexp_matches(substr(t, stop + 1, 1), '[A-Za-z0-9]')"
AROUND = "(substr(t, greatest(start - 40, 0) + 1, least(start, 40)) || ' ' || chr(8233) || ' ' || substr(t, stop + 1, 40))"


def said_near(patterns: dict[str, str]) -> str:
    return "(" + " OR ".join(f"(kind = '{k}' AND regexp_matches({AROUND}, '{p}'))" for k, p in patterns.items()) + ")"


WORTH = "CASE kind " + " ".join(f"WHEN '{k}' THEN {pii.START + (pii.CHECKED if k in ('card', 'iban') else 0.0)}" for k in pii.KINDS) + " END"
OP3 = f"""WITH {TEXTS}, s AS ({PERSONAL} UNION ALL SELECT i.* FROM ({IBANS}) i JOIN texts USING (doc_id) WHERE {EDGES}),
  j AS (SELECT s.*, round({WORTH} + CASE WHEN {said_near(pii.CONTEXT)} THEN {pii.FOR} WHEN {said_near(pii.AGAINST)} THEN -{pii.COUNTER} ELSE 0.0 END, 3) AS score FROM s JOIN texts USING (doc_id)),
  d AS (SELECT doc_id, {', '.join(f"count(*) FILTER (number = {i}) AS n_{k}" for i, k in enumerate(('email', 'ip', 'card', 'phone')))},
    string_agg({SAID}, ',' ORDER BY number, start) FILTER (number < 4) AS base, string_agg({SAID}, ',' ORDER BY number, start) AS spans, max(score) AS score FROM j GROUP BY doc_id)
  SELECT t.doc_id, {', '.join(f"coalesce(n_{k}, 0) AS n_{k}" for k in ('email', 'ip', 'card', 'phone'))}, sha256(coalesce(base, '')) AS base_sha256,
    coalesce(spans, '') AS spans, cast(coalesce(score, 0.0) AS double) AS score FROM texts t LEFT JOIN d USING (doc_id)"""

OP4 = f"""WITH d AS (SELECT doc_id, {words('text')} AS w FROM documents), b AS (SELECT item_id, {words('text')} AS w FROM benchmark),
  g AS (SELECT DISTINCT cast(item_id AS varchar) AS item, least(8, len(w)) AS size, array_to_string(w[i:i + least(8, len(w)) - 1], ' ') AS gram
    FROM b, unnest(range(1, greatest(len(w) - 8, 0) + 2)) r(i) WHERE len(w) > 0),
  p AS (SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS gram FROM (SELECT DISTINCT size FROM g) z, d, unnest(range(1, len(w) - size + 2)) r(i)),
  h AS (SELECT doc_id, i, size, item FROM p JOIN g USING (size, gram)),
  c AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM h, unnest(range(i, i + size)) r(k) GROUP BY doc_id),
  n AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY doc_id)
  SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n_items, 0) >= 2 AS contaminated FROM d LEFT JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)"""

_PLACES = " UNION ALL ".join(
    f"SELECT doc_id, '{label}' AS label, i - 1 AS place FROM d, unnest(range(1, len(w) - {len(p.split()) - 2})) r(i) WHERE "
    + " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(p.split()))
    for p, label in PHRASES.items()
)
_TEMPLATES = ", ".join(
    f"([{', '.join(repr(w) for w in sorted(set(t.split())))}], '{label}', {math.ceil(0.8 * len(set(t.split())))})" for t, label in TEMPLATES
)
OP8 = f"""WITH d AS (SELECT doc_id, {words('text')} AS w FROM documents), p AS ({_PLACES}),
  l AS (SELECT doc_id, list_distinct({words('line')}) AS w FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)),
  t(words, label, need) AS (VALUES {_TEMPLATES}),
  m AS (SELECT doc_id, label, len(list_intersect(l.w, words)) / len(words) AS share FROM l, t WHERE len(l.w) >= need AND len(list_intersect(l.w, words)) >= need),
  b AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM p GROUP BY doc_id),
  a AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM p UNION ALL SELECT doc_id, label FROM m) GROUP BY doc_id),
  s AS (SELECT doc_id, max(share) AS share FROM m GROUP BY doc_id)
  SELECT d.doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
    cast(coalesce(share, CASE WHEN n_base > 0 THEN 0.5 END, 0.0) AS double) AS score
  FROM d LEFT JOIN b USING (doc_id) LEFT JOIN a USING (doc_id) LEFT JOIN s USING (doc_id)"""

ORACLES = {"op2_secret_scan": OP2, "op3_pii_scan": OP3, "op4_decontaminate": OP4, "op8_license_scan": OP8}
