"""The queries in DuckDB's SQL, where SQL can express them: over whole tables and whole texts, by plain counting.

Not here: what a tokenizer, a trained model, an HTML parser or a 128-bit xxhash
of normalised text decides (op1, op2, op4, op6, op7, op10).
"""

from __future__ import annotations

from ckptlake.llm import licenses

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANK_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"
_ALNUM_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP3 = f"""WITH RECURSIVE w AS (SELECT doc_id, {_BLANK_WORDS} AS w FROM documents),
  s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM w),
  n AS (SELECT doc_id, len(s) AS n FROM s), x AS (SELECT doc_id, unnest(s) AS g FROM s),
  o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
  l AS (SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * m >= 85 * (p.n + q.n - m)),
  e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
  r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
  c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
  SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c USING (doc_id)"""

OP5 = f"""WITH i AS (SELECT item_id, {_ALNUM_WORDS} AS w FROM benchmark),
  p AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 7], ' ') AS p, least(len(w), 8) AS size FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
  d AS (SELECT row_number() OVER () AS r, doc_id, {_ALNUM_WORDS} AS w FROM documents),
  g AS (SELECT r, k, size, array_to_string(w[k:k + size - 1], ' ') AS p FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM d, (SELECT DISTINCT size FROM p))),
  h AS (SELECT r, k, size, item_id FROM g JOIN p USING (p, size)),
  c AS (SELECT r, count(DISTINCT word) AS n_hit FROM (SELECT r, unnest(range(k, k + size)) AS word FROM h) GROUP BY 1),
  f AS (SELECT r, count(DISTINCT item_id) AS n_items, list_sort(list(DISTINCT CAST(item_id AS VARCHAR)) FILTER (WHERE item_id IS NOT NULL)) AS items FROM h GROUP BY 1)
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated FROM d LEFT JOIN c USING (r) LEFT JOIN f USING (r)"""

#: Blocks of 64 bytes in hex, each beside the next, so that the 50 bytes from any place are cut from a short string.
OP8 = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
  b AS (SELECT doc_id, unnest(x) AS x, generate_subscripts(x, 1) - 1 AS k FROM (SELECT doc_id, regexp_extract_all(h, '.{1,128}') AS x FROM d)),
  t AS (SELECT doc_id, k, x || coalesce(lead(x) OVER (PARTITION BY doc_id ORDER BY k), '') AS x FROM b),
  g AS (SELECT doc_id, k * 64 + o AS p, substring(x, CAST(2 * o + 1 AS INTEGER), 100) AS g FROM t, range(64) r(o) WHERE 2 * o + 100 <= length(x)),
  m AS (SELECT g, min(doc_id) AS least FROM g GROUP BY 1),
  h AS (SELECT doc_id, p FROM g JOIN m USING (g) WHERE least < doc_id),
  n AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS new FROM h),
  u AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS z FROM (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS run FROM n) GROUP BY doc_id, run),
  e AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS open FROM u),
  k AS (SELECT doc_id, count(*) AS n_spans, sum(z - a) AS gone, string_agg(substring(h, CAST(2 * open + 1 AS INTEGER), CAST(2 * (a - open) AS INTEGER)), '' ORDER BY a) AS kept, max(z) AS z FROM e JOIN d USING (doc_id) GROUP BY 1)
  SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, '') || substring(h, CAST(2 * coalesce(z, 0) + 1 AS INTEGER)))) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""


def _op9() -> str:
    rows = ", ".join(f"({k}, '{label}', {'true' if base else 'false'}, '{words}')" for k, label, words, base in licenses.templates())
    return f"""WITH t(template, label, base, text) AS (VALUES {rows}), tw AS (SELECT template, label, base, string_split(text, ' ') AS w FROM t),
  tg AS (SELECT template, label, base, len(w) AS words, j - 1 AS j, w[j] || ' ' || w[j + 1] || ' ' || w[j + 2] AS g FROM (SELECT *, unnest(range(1, len(w) - 1)) AS j FROM tw)),
  d AS (SELECT row_number() OVER () AS r, doc_id, {_ALNUM_WORDS} AS w FROM documents),
  dg AS (SELECT r, i - 1 AS i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
  l AS (SELECT r, template, label, base, words, i - j AS diagonal, min(i) AS lo, max(i) AS hi, count(*) AS n FROM dg JOIN tg USING (g) GROUP BY ALL),
  exact AS (SELECT r, label, base, diagonal AS first, 1.0::DOUBLE AS cover FROM l WHERE base AND n = words - 2),
  x AS (SELECT *, CASE WHEN abs(diagonal - lag(diagonal) OVER v) <= {licenses.DRIFT} AND lo - lag(hi) OVER v <= {licenses.GAP} AND lo > lag(hi) OVER v THEN 0 ELSE 1 END AS new FROM l WHERE NOT base WINDOW v AS (PARTITION BY r, template ORDER BY lo, diagonal)),
  y AS (SELECT *, sum(new) OVER (PARTITION BY r, template ORDER BY lo, diagonal ROWS UNBOUNDED PRECEDING) AS run FROM x),
  z AS (SELECT r, label, base, words, min(lo) AS first, max(hi) + 2 AS last, least(sum(n)::DOUBLE / (words - 2), 1.0) AS cover FROM y GROUP BY r, template, label, base, words, run),
  s AS (SELECT * FROM exact UNION ALL SELECT r, label, base, first, cover FROM z WHERE cover >= {licenses.COVER} AND last - first + 1 <= 1.5 * words),
  f AS (SELECT r, count(*) FILTER (WHERE base) AS n_base, min(first) FILTER (WHERE base) AS first_word, max(first) FILTER (WHERE base) AS last_word, max(cover) AS score,
    array_to_string(list_sort(list(DISTINCT label) FILTER (WHERE base)), ',') AS base_labels, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels FROM s GROUP BY 1)
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score FROM d LEFT JOIN f USING (r)"""


ORACLE_SQL = {"op3_minhash": OP3, "op5_decontaminate": OP5, "op8_suffix_dedup": OP8, "op9_licenses": _op9()}
