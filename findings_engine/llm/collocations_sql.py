"""Operator 11's query in SQL: all phrases counted, every cut by a join."""

from .collocations import COVER, DEFAULT_LANG, LEAST, LONGEST, SCALE, TOP

SQL = f"""WITH t AS (SELECT coalesce(lang, '{DEFAULT_LANG}') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS MATERIALIZED (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM t),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
f AS MATERIALIZED (SELECT lang, g, len(g) AS k, count(*) AS f FROM (SELECT lang, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) AS g FROM w, range(1, {LONGEST + 1}) s(k) WHERE len(w) >= k) GROUP BY lang, g),
c AS MATERIALIZED (SELECT * FROM f WHERE k >= 2 AND f >= {LEAST}),
inside AS (SELECT lang, unnest(list_transform(range(1, k - m + 2), lambda i: g[i:i + m - 1])) AS g, f FROM c, range(2, {LONGEST}) s(m) WHERE m < k),
kept AS (SELECT c.* FROM c LEFT JOIN (SELECT lang, g, max(f) AS longer FROM inside GROUP BY lang, g) USING (lang, g) WHERE longer IS NULL OR 100 * longer < {COVER} * f),
cuts AS (SELECT c.lang, c.g, c.f AS a, j, l.f AS l, r.f AS r, n, ({SCALE}::HUGEINT * c.f * n) // (l.f::HUGEINT * r.f) AS score FROM (SELECT *, unnest(range(1, k)) AS j FROM kept) c JOIN f l ON l.lang = c.lang AND l.g = c.g[1:c.j] JOIN f r ON r.lang = c.lang AND r.g = c.g[c.j + 1:] JOIN n ON n.lang = c.lang),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank, array_to_string(g, ' ') AS phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM best QUALIFY rank <= {TOP}"""
