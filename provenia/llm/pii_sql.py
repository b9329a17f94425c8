"""The personal data query in SQL, with the plain patterns; for documents whose doc_id is unique."""

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[ -]?[0-9])+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}


def located(name: str, source: str, cols: str, text: str, pat: str, kind: str) -> str:
    """Rows of the pattern's matches in ``text``: value, s (offset, code points) and n (length), from matches and what stands between."""
    return f"""{name}_l AS (SELECT {cols}, regexp_extract_all({text}, '{pat}') AS ms, string_split_regex({text}, '{pat}') AS bs FROM {source}),
{name}_u AS (SELECT {cols}, bs, ms, unnest(range(1, len(ms) + 1)) AS i FROM {name}_l WHERE len(ms) > 0),
{name} AS (SELECT {cols}, {kind} AS kind, ms[i] AS value, CAST(list_sum(list_transform(bs[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s, length(ms[i]) AS n FROM {name}_u)"""


parts = ["d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)"]
parts += [located(k, "d", "doc_id", "text", p, f"'{k}'") for k, p in PATTERNS.items()]
parts.append("""a AS (SELECT * FROM email UNION ALL SELECT * FROM ip UNION ALL SELECT * FROM card UNION ALL SELECT * FROM phone),
g AS (SELECT *, regexp_replace(value, '[^0-9]', '', 'g') AS digits FROM a),
b AS (SELECT doc_id, kind, s, s + n AS e, kind || ':' || CASE kind WHEN 'email' THEN lower(value) WHEN 'ip' THEN value ELSE digits END AS entity FROM g
  WHERE CASE kind WHEN 'email' THEN TRUE WHEN 'phone' THEN length(digits) BETWEEN 8 AND 15
    WHEN 'ip' THEN list_bool_and(list_transform(string_split(value, '.'), lambda x: length(ltrim(x, '0')) <= 3 AND coalesce(TRY_CAST(ltrim(x, '0') AS INT), 0) <= 255))
    ELSE length(digits) BETWEEN 16 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr(reverse(digits), i, 1) AS INT)
      WHEN CAST(substr(reverse(digits), i, 1) AS INT) > 4 THEN 2 * CAST(substr(reverse(digits), i, 1) AS INT) - 9 ELSE 2 * CAST(substr(reverse(digits), i, 1) AS INT) END)) % 10 = 0 END),
he AS (SELECT entity, count(DISTINCT doc_id) AS n FROM b JOIN d USING (doc_id) GROUP BY entity HAVING count(DISTINCT text) >= 3),
h AS (SELECT DISTINCT doc_id, entity FROM b SEMI JOIN he USING (entity)),
w AS (SELECT doc_id, text FROM d SEMI JOIN h USING (doc_id))""")
parts.append(located("run", "w", "doc_id", "text", r"\p{L}+", "'term'"))
parts.append("""near AS (SELECT doc_id, lower(value) AS term, s, s + n AS e FROM run WHERE n BETWEEN 4 AND 40
  AND NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = run.doc_id AND run.s < b.e AND run.s + run.n > b.s)),
pr AS (SELECT entity, term, count(DISTINCT doc_id) AS both_ FROM (SELECT DISTINCT doc_id, term FROM near) JOIN h USING (doc_id) JOIN d USING (doc_id) GROUP BY ALL HAVING count(DISTINCT text) >= 3),
tt AS (SELECT DISTINCT term FROM pr),
ft AS (SELECT term, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS term FROM d) SEMI JOIN tt USING (term) GROUP BY term),
k AS (SELECT entity, term FROM pr JOIN ft USING (term) JOIN he USING (entity), (SELECT count(*)::DOUBLE AS total FROM d)
  WHERE ln(total / he.n) > 0 AND ln(both_ * total / (he.n * ft.n)) >= 0.8::DOUBLE * ln(total / he.n)),
sp AS (SELECT doc_id, kind, s, e, CASE kind WHEN 'email' THEN 1 WHEN 'ip' THEN 2 WHEN 'card' THEN 3 ELSE 4 END AS o FROM b UNION SELECT doc_id, 'term', s, e, 5 FROM near JOIN h USING (doc_id) SEMI JOIN k USING (entity, term)),
z AS (SELECT doc_id, coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY o, s, e), '') AS spans, coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY o, s, e) FILTER (o < 5), '') AS base,
  count(*) FILTER (o = 1) AS n_email, count(*) FILTER (o = 2) AS n_ip, count(*) FILTER (o = 3) AS n_card, count(*) FILTER (o = 4) AS n_phone FROM sp GROUP BY doc_id)""")
SQL = "WITH " + ",\n".join(parts) + "\nSELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN z USING (doc_id)"
