"""DuckDB SQL for the span operators; patterns as the contracts have them."""

from __future__ import annotations

from . import pii, secrets


def _spans(kinds: list[tuple[int, str, str]]) -> str:
    """Common tables d (rows), p (rid, kind, start, stop, m) of standing matches."""
    quote = lambda s: s.replace("'", "''")
    found = " UNION ALL ".join(f"SELECT rid, {k} AS kind, regexp_extract_all(text, '{quote(p)}') AS ms, string_split_regex(text, '{quote(p)}') AS gs FROM d" for k, p, _ in kinds)
    keep = " ".join(f"WHEN {k} THEN {c}" for k, _, c in kinds)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
f AS ({found}),
i AS (SELECT rid, kind, ms, gs, unnest(range(1, len(ms) + 1)) AS n FROM f WHERE len(ms) > 0),
q AS (SELECT rid, kind, ms[n] AS m,
        CAST(list_sum(list_transform(gs[1:n], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:n - 1], lambda x: length(x))), 0) AS BIGINT) AS start FROM i),
p AS (SELECT rid, kind, m, start, start + length(m) AS stop FROM q WHERE CASE kind {keep} END)
"""


def _names(names: list[str], column: str = "kind") -> str:
    return f"CASE {column} " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names)) + " END"


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"""list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda j: CASE WHEN j % 2 = 1 THEN CAST(reverse({_DIGITS})[j] AS INT)
  ELSE (CAST(reverse({_DIGITS})[j] AS INT) * 2) % 10 + CAST(reverse({_DIGITS})[j] AS INT) // 5 END)) % 10 = 0"""
_MOD97 = """list_reduce(list_transform(string_split(m[5:] || m[1:4], ''), lambda c: ascii(c)), lambda a, c: CASE WHEN c < 58 THEN (a * 10 + c - 48) % 97 ELSE (a * 100 + c - 55) % 97 END, 0) = 1"""
_PII = [
    (0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    (1, r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "list_bool_and(list_transform(string_split(m, '.'), lambda x: CAST(x AS DOUBLE) <= 255))"),
    (2, r"[0-9](?:[ -]?[0-9])+", f"length({_DIGITS}) BETWEEN 14 AND 19 AND {_LUHN}"),
    (3, r"\+[0-9][ ().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 10 AND 15"),
    (4, r"[A-Z0-9]{15,}", f"regexp_full_match(m, '[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}') AND {_MOD97}"),
    (5, r"[0-9-]{11,}", "regexp_full_match(m, '[0-9]{3}-[0-9]{3}-[0-9]{4}')"),
    (6, r"[0-9-]{11,}", "regexp_full_match(m, '[0-9]{3}-[0-9]{2}-[0-9]{4}')"),
]


def pii_sql() -> str:
    near = f"lower(substr(text, CAST(greatest(start - {pii.WINDOW}, 0) AS BIGINT) + 1, CAST(start - greatest(start - {pii.WINDOW}, 0) AS BIGINT)) || ' ' || substr(text, stop + 1, {pii.WINDOW}))"
    score = " ".join(f"WHEN {k} THEN CASE WHEN regexp_matches({near}, '(^|[^a-z])({pii.CONTEXT[n]})') THEN {min(1.0, round(a + b, 6))} ELSE {a} END" for k, (n, (a, b)) in enumerate(pii.SCORES.items()))
    item = _names(pii.NAMES) + " || ':' || start || ':' || stop"
    counts = ", ".join(f"CAST(count(*) FILTER (kind = {k}) AS BIGINT) AS n_{n}" for k, n in enumerate(pii.NAMES[:4]))
    return f"""{_spans(_PII)},
s AS (SELECT rid, kind, start, stop, CAST(CASE kind {score} END AS DOUBLE) AS score FROM p JOIN d USING (rid)),
k AS (SELECT * FROM s WHERE kind < 4 OR score >= {pii.THRESHOLD}),
g AS (SELECT rid, {counts}, string_agg({item}, ',' ORDER BY start, kind) FILTER (kind < 4) AS base, string_agg({item}, ',' ORDER BY start, kind) AS spans,
       string_agg(CAST(score AS VARCHAR), ',' ORDER BY start, kind) AS scores FROM k GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{n}, 0) AS n_{n}" for n in pii.NAMES[:4])}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores
FROM d LEFT JOIN g USING (rid)"""


_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_VALUE = f"""length(regexp_extract(m, '{_ASSIGN.replace("'", "''")}', 1))"""
_SECRETS = [
    (0, _ASSIGN, f"{_VALUE} >= 12"),
    (1, r"AKIA[A-Z0-9]+", "length(m) >= 18"),
    (2, r"[0-9a-f]+", "length(m) >= 16"),
    (3, _ASSIGN, f"{_VALUE} BETWEEN 4 AND 11"),
    (4, r"AKIA[A-Z0-9]+", "length(m) BETWEEN 10 AND 17"),
    (5, r"""(?i:access_?key_?id|client_?id|user_?name|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@_.-]{3,}""", "true"),
    (6, r"[A-Za-z0-9+/]{32,}", "length(m) = 40 AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]')"),
    (7, r"[a-z][a-z0-9+]{1,12}://[A-Za-z0-9._:@-]+", "true"),
]


def secrets_sql() -> str:
    fits = " OR ".join(f"(w.kind = {k} AND o.kind IN ({', '.join(map(str, need))}))" for k, need in secrets.NEEDS.items())
    item = _names(secrets.NAMES) + " || ':' || start || ':' || stop"
    names = secrets.NAMES[:3]
    counts = ", ".join(f"CAST(count(*) FILTER (kind = {k}) AS BIGINT) AS n_{n}" for k, n in enumerate(names))
    return f"""{_spans(_SECRETS)},
k AS (SELECT * FROM p WHERE kind < 3 UNION ALL SELECT * FROM p w WHERE kind >= 3 AND EXISTS (
  SELECT 1 FROM p o WHERE o.rid = w.rid AND o.start <= w.stop + {secrets.SCOPE} AND o.stop >= w.start - {secrets.SCOPE} AND ({fits}))),
g AS (SELECT rid, {counts}, string_agg({item}, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg({item}, ',' ORDER BY start, kind) AS spans,
       CAST(count(*) FILTER (kind >= 3) AS BIGINT) AS n_linked FROM k GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{n}, 0) AS n_{n}" for n in names)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_linked, 0) AS n_linked
FROM d LEFT JOIN g USING (rid)"""
