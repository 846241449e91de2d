"""DuckDB SQL for the span operators, written from the contracts."""

from __future__ import annotations

from graphloom.llm import pii, secret_scan


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _matches(kind: str, place: int, pattern: str) -> str:
    """Every leftmost match without overlap, with its place: the pieces between
    the matches and the matches before it add up to its start."""
    return f"""
SELECT rid, {place} AS k, {_quote(kind)} AS kind, v,
       CAST(sum(length(p)) OVER w + coalesce(sum(length(v)) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s
FROM (SELECT rid, unnest(ps) AS p, unnest(ms) AS v, generate_subscripts(ps, 1) AS i
      FROM (SELECT rid, string_split_regex(t, {_quote(pattern)}) AS ps, regexp_extract_all(t, {_quote(pattern)}) AS ms FROM d))
WINDOW w AS (PARTITION BY rid ORDER BY i)"""


def _digest(kinds: list[str], base: int, matches: str, more: str = "") -> str:
    counts = ", ".join(f"count(*) FILTER (WHERE k = {i}) AS n_{kinds[i]}" for i in range(base))
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({matches}),
a AS (SELECT rid, {counts},
      coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (WHERE k < {base}), '') AS own,
      string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans{more}
      FROM m GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{kinds[i]}, 0) AS n_{kinds[i]}" for i in range(base))},
       sha256(coalesce(own, '')) AS base_sha256, coalesce(spans, '') AS spans{", coalesce(scores, '') AS scores" if more else ""}
FROM d LEFT JOIN a USING (rid)"""


def secrets_sql() -> str:
    parts = []
    for place, r in enumerate(secret_scan.RULES):
        value = f"regexp_extract(v, {_quote(r.pattern)}, {r.group})" if r.group else "v"
        parts.append(f"SELECT rid, k, kind, s, s + length(v) AS e FROM ({_matches(r.kind, place, r.pattern)}) WHERE v IS NOT NULL AND length({value}) >= {r.least}")
    return _digest([r.kind for r in secret_scan.RULES], len(secret_scan.BASE_RULES), "\nUNION ALL\n".join(parts))


_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_LUHN = f"""list_sum(list_transform(range(length({_DIGITS})), lambda j:
  CASE WHEN j % 2 = 0 THEN CAST({_DIGITS}[length({_DIGITS}) - j] AS INTEGER)
       ELSE (2 * CAST({_DIGITS}[length({_DIGITS}) - j] AS INTEGER)) // 10 + (2 * CAST({_DIGITS}[length({_DIGITS}) - j] AS INTEGER)) % 10 END)) % 10 = 0"""
_BARE = "replace(v, ' ', '')"
_MOD97 = f"""list_reduce(list_prepend(0, list_transform(string_split(substr({_BARE}, 5) || substr({_BARE}, 1, 4), ''), lambda c:
  CASE WHEN c <= '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)),
  lambda x, y: CASE WHEN y < 10 THEN (x * 10 + y) % 97 ELSE (x * 100 + y) % 97 END) = 1"""
_VALID = {
    "email": "true",
    "ip": "len(list_filter(string_split(v, '.'), lambda x: length(ltrim(x, '0')) > 3 OR CAST('0' || right(ltrim(x, '0'), 3) AS INTEGER) > 255)) = 0",
    "card": f"length({_DIGITS}) BETWEEN 12 AND 19 AND {_LUHN}",
    "phone": f"length({_DIGITS}) BETWEEN 9 AND 15",
    "iban": f"length({_BARE}) BETWEEN 15 AND 34 AND {_MOD97}",
    "ssn": "NOT regexp_matches((CASE WHEN s > 0 THEN substr(t, s, 1) ELSE '' END) || substr(t, s + 1 + length(v), 1), '[0-9-]')",
}


def _near(words: list[str]) -> str:
    pattern = _quote("(^|[^a-z])(" + "|".join(words) + ")([^a-z]|$)")
    return f"(regexp_matches(before, {pattern}) OR regexp_matches(after, {pattern}))"


def _low(text: str) -> str:
    return f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def pii_sql() -> str:
    parts = []
    for place, kind in enumerate(pii.KINDS):
        keep = "" if kind in pii.BASE_KINDS else f" WHERE score >= {pii.KEEP}"
        parts.append(f"""
SELECT rid, k, kind, s, e, score FROM (
  SELECT *, greatest(0, least(100, {pii.PRIOR[kind]} + CASE WHEN {_near(pii.SUPPORT[kind])} THEN {pii.RAISE} ELSE 0 END
                                   - CASE WHEN {_near(pii.AGAINST[kind])} THEN {pii.LOWER} ELSE 0 END)) AS score
  FROM (SELECT x.*, s + length(v) AS e,
               {_low(f"substr(t, greatest(0, s - {pii.BEFORE}) + 1, s - greatest(0, s - {pii.BEFORE}))")} AS before,
               {_low(f"substr(t, s + length(v) + 1, {pii.AFTER})")} AS after
        FROM ({_matches(kind, place, pii.PATTERNS[kind])}) x JOIN d USING (rid)
        WHERE v IS NOT NULL AND {_VALID[kind]})){keep}""")
    return _digest(pii.KINDS, len(pii.BASE_KINDS), "\nUNION ALL\n".join(parts), ", string_agg(CAST(score AS VARCHAR), ',' ORDER BY s, k) AS scores")


_COMPONENTS = """e AS MATERIALIZED (SELECT a AS src, b AS dst FROM l UNION ALL SELECT b, a FROM l),
r(id, c) AS (SELECT id, id FROM n UNION SELECT e.dst, r.c FROM r JOIN e ON e.src = r.id WHERE r.c < e.dst),
k AS (SELECT id, min(c) AS c FROM r GROUP BY id)"""


def near_dedup_sql() -> str:
    return f"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id AS id, regexp_extract_all({_low("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM w),
n AS MATERIALIZED (SELECT id, CAST(len(g) AS BIGINT) AS n FROM s),
x AS MATERIALIZED (SELECT id, unnest(g) AS g FROM s),
p AS MATERIALIZED (SELECT a.id AS a, b.id AS b, count(*) AS k FROM x a JOIN x b ON b.g = a.g AND a.id < b.id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n na ON na.id = a JOIN n nb ON nb.id = b WHERE 100 * k >= 75 * (na.n + nb.n - k)),
{_COMPONENTS}
SELECT n.id AS doc_id, n.n AS n_shingles, c AS component_id, c = n.id AS kept FROM n JOIN k ON k.id = n.id"""


def embedding_dedup_sql() -> str:
    return f"""
WITH RECURSIVE v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
n AS MATERIALIZED (SELECT id FROM v),
u AS MATERIALIZED (SELECT id, v, sqrt(list_dot_product(v, v)) AS size FROM v
  WHERE len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM u a JOIN u b ON a.id < b.id AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / (a.size * b.size) >= 0.9),
{_COMPONENTS},
q AS (SELECT src AS id, count(*) AS q FROM e GROUP BY src)
SELECT n.id AS vec_id, coalesce(q, 0) AS n_links, c AS component_id, c = n.id AS kept FROM n JOIN k ON k.id = n.id LEFT JOIN q ON q.id = n.id"""
