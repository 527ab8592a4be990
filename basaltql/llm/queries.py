"""The queries of this subpackage, and SQL for those that SQL can express.

What the methods of op1, op3 and op8 add has no SQL form; base_pii, base_quality and base_secrets are the columns of the same
queries that SQL can express, so that they are held against it on whole tables."""

from __future__ import annotations

from .bpe import op10_bpe
from .language_id import op7_language_id
from .line_dedup import op9_line_dedup
from .near_dedup import op5_near_dedup
from .packing import op4_packing
from .pii import op1_pii
from .quality_rules import op3_quality_rules
from .secret_scan import op8_secret_scan
from .substring_dedup import op6_substring_dedup
from .topk_search import OP2_SQL, op2_topk_search

QUERIES = {f.__name__: f for f in (op1_pii, op2_topk_search, op3_quality_rules, op4_packing, op5_near_dedup, op6_substring_dedup, op7_language_id, op8_secret_scan, op9_line_dedup, op10_bpe)}
ORACLE_SQL = {"op2_topk_search": OP2_SQL}
BASE = {
    "base_pii": (op1_pii, ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"]),
    "base_quality": (op3_quality_rules, ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]),
    "base_secrets": (op8_secret_scan, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256"]),
}
QUERIES |= {name: lambda spark, sf_dir, f=f, c=columns: f(spark, sf_dir).select(*c) for name, (f, columns) in BASE.items()}


def _spans(kinds: list[tuple[str, str, str]], order: str) -> str:
    """Counts of each kind's matches (pattern, and what a match v must hold), and the hash of their spans in the order given."""
    found = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, {i} AS o, regexp_extract_all(t, '{p}') AS m, string_split_regex(t, '{p}') AS g FROM d" for i, (k, p, _) in enumerate(kinds))
    kept = " OR ".join(f"(kind = '{k}' AND {keep})" for k, _, keep in kinds)
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k, _, _ in kinds)
    size = "coalesce(list_sum(list_transform({}, lambda x: length(x))), 0)".format
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({found}),
r AS (SELECT doc_id, kind, o, m, g, unnest(range(1, len(m) + 1)) AS i FROM f),
s AS (SELECT doc_id, kind, o, CAST({size("g[1:i]")} + {size("m[1:i - 1]")} AS BIGINT) AS a, m[i] AS v FROM r),
k AS (SELECT * FROM s WHERE {kept})
SELECT d.doc_id, {counts}, sha256(coalesce(string_agg(kind || ':' || a || ':' || (a + length(v)), ',' ORDER BY {order}), '')) AS base_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id GROUP BY d.doc_id"""


_DIGITS = "regexp_replace(v, ''[^0-9]'', '''', ''g'')".replace("''", "'")
_REVERSED = f"list_reverse(list_transform(string_split({_DIGITS}, ''), lambda x: CAST(x AS INT)))"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda j: CASE WHEN j % 2 = 1 THEN {_REVERSED}[j] ELSE 2 * {_REVERSED}[j] - CASE WHEN {_REVERSED}[j] > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
ORACLE_SQL["base_pii"] = _spans(
    [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
        ("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "list_max(list_transform(string_split(v, '.'), lambda x: CAST(x AS HUGEINT))) <= 255"),
        ("card", r"[0-9](?:[\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 16 AND 19 AND {_LUHN}"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 8 AND 15"),
    ],
    "o, a",
)
ORACLE_SQL["base_secrets"] = _spans(
    [
        ("assign", r"(?i:password|passwd|secret|token|api_?key)[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?[A-Za-z0-9+/_.=-]+", r"length(regexp_extract(v, '^(?i:password|passwd|secret|token|api_?key)[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?([A-Za-z0-9+/_.=-]+)$', 1)) >= 12"),
        ("access", "AKIA[A-Z0-9]+", "length(v) >= 18"),
        ("hex", "[0-9a-f]+", "length(v) >= 16"),
    ],
    "a, o",
)
ORACLE_SQL["base_quality"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
x AS (SELECT doc_id, unnest(w) AS a, unnest(range(1, len(w) + 1)) AS i FROM w),
y AS (SELECT doc_id, i, a, lead(a) OVER p AS b, lead(a, 2) OVER p AS c FROM x WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM y WHERE c IS NOT NULL),
c AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM g, (SELECT unnest(range(3)) AS j) WHERE n > 1 GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
  FROM w LEFT JOIN c ON w.doc_id = c.doc_id
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
"""
