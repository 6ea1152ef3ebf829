"""DuckDB SQL of contracts that SQL can express, independent of the operators' methods."""

_FOLDED = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Every window of the benchmark against every window of the documents, as text.
OP2 = rf"""
WITH b AS (SELECT item_id::VARCHAR AS item, {_FOLDED} AS w FROM benchmark),
bw AS (SELECT item, w, least(13, len(w)) AS m, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
p AS (SELECT DISTINCT item, m, array_to_string(w[i : i + m - 1], ' ') AS win FROM bw),
d AS (SELECT row_number() OVER () AS r, doc_id, {_FOLDED} AS w FROM documents),
dw AS (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM p) WHERE len(w) >= m),
h AS (SELECT r, i, dw.m, item FROM dw JOIN p ON p.m = dw.m AND p.win = array_to_string(w[i : i + dw.m - 1], ' ')),
n AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS j FROM h) GROUP BY r),
t AS (SELECT r, list_sort(list(DISTINCT item)) AS items FROM h WHERE item IS NOT NULL GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN t USING (r)
"""

OP6_BASE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT r, line, count(*) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY ALL),
u AS (SELECT r, sum(n - 1)::BIGINT AS n_dup FROM l GROUP BY r),
g AS (SELECT r, i, w[i : i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
k AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g),
p AS (SELECT r, count(DISTINCT j) AS n_rep FROM (SELECT r, unnest(range(i, i + 3)) AS j FROM k WHERE n > 1) GROUP BY r),
x AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(n_rep, 0)::BIGINT AS n_repeat_words
      FROM d LEFT JOIN u USING (r) LEFT JOIN p USING (r))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM x
"""


def _kind(kind: str, rule: str, holds: str) -> str:
    """(r, kind, start, end) of the rule's matches that hold; offsets from the gaps between matches."""
    return rf"""
{kind}_m AS (SELECT r, regexp_extract_all(t, '{rule}') AS m, regexp_split_to_array(t, '{rule}') AS g FROM d WHERE regexp_matches(t, '{rule}')),
{kind}_i AS (SELECT r, m, g, unnest(range(1, len(m) + 1)) AS i FROM {kind}_m),
{kind} AS (SELECT r, m[i] AS v, (list_sum(list_transform(g[1 : i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1 : i - 1], lambda x: length(x))), 0))::BIGINT AS s,
                  regexp_replace(m[i], '[^0-9]', '', 'g') AS n FROM {kind}_i),
{kind}_v AS (SELECT r, '{kind}' AS kind, s, s + length(v) AS e FROM {kind} WHERE {holds})"""


_LUHN = "list_sum(list_transform(range(1, length(n) + 1), lambda k: CASE WHEN (length(n) - k) % 2 = 0 THEN n[k]::INT WHEN n[k]::INT > 4 THEN 2 * n[k]::INT - 9 ELSE 2 * n[k]::INT END)) % 10 = 0"
_KINDS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "len(list_filter(string_split(v, '.'), lambda p: p::HUGEINT > 255)) = 0"),
    ("card", r"[0-9](?:[\x20-]?[0-9])+", f"length(n) BETWEEN 13 AND 19 AND {_LUHN}"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "length(n) BETWEEN 9 AND 15"),
]
OP9_BASE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),{",".join(_kind(*k) for k in _KINDS)},
a AS (SELECT *, 1 AS k FROM email_v UNION ALL SELECT *, 2 FROM ip_v UNION ALL SELECT *, 3 FROM card_v UNION ALL SELECT *, 4 FROM phone_v),
c AS (SELECT r, count(*) FILTER (k = 1) AS n1, count(*) FILTER (k = 2) AS n2, count(*) FILTER (k = 3) AS n3, count(*) FILTER (k = 4) AS n4, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s) AS spans FROM a GROUP BY r)
SELECT doc_id, coalesce(n1, 0)::BIGINT AS n_email, coalesce(n2, 0)::BIGINT AS n_ip, coalesce(n3, 0)::BIGINT AS n_card, coalesce(n4, 0)::BIGINT AS n_phone, sha256(coalesce(spans, '')) AS base_sha256
FROM d LEFT JOIN c USING (r)
"""
