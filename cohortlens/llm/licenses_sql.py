"""The licence scan in DuckDB's SQL."""

from __future__ import annotations

from cohortlens.llm.licenses import TEMPLATES


def licenses_sql(least: float = 0.8) -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quoted(n)}, {quoted(p)})" for n, p in sorted(TEMPLATES.items()))
    words = lambda c: f"list_filter(regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
    pairs = """list_transform(range(1, len(words) + 2), lambda i: CASE WHEN i = 1 THEN '<' ELSE words[i - 1] END || ' ' ||
      CASE WHEN i > len(words) THEN '>' ELSE words[i] END)"""
    numbered = "list_transform(pairs, lambda x, i: x || ' ' || len(list_filter(pairs[1:i - 1], lambda y: y = x)))"
    return f"""
WITH t0 AS (SELECT name, {words('passage')} AS words FROM (VALUES {values}) v(name, passage)),
t1 AS (SELECT name, {pairs} AS pairs FROM t0),
t AS (SELECT name, {numbered} AS bag, len(pairs) AS size FROM t1),
b0 AS (SELECT doc_id, regexp_split_to_array(text, '\\n[ \\t\\r]*\\n') AS blocks FROM documents WHERE text IS NOT NULL),
b AS (SELECT doc_id, unnest(range(0, len(blocks))) AS block, unnest(blocks) AS passage FROM b0),
l AS (SELECT doc_id, block, string_split(passage, chr(10)) AS lines, passage FROM b),
u AS (SELECT doc_id, block, unnest(range(0, len(lines))) AS line, unnest(lines) AS part FROM l
  UNION ALL SELECT doc_id, block, -1, passage FROM l WHERE len(lines) > 1),
w AS (SELECT row_number() OVER () AS unit, doc_id, block, line, {words('part')} AS words FROM u),
able AS (SELECT * FROM w WHERE len(words) > 0 AND EXISTS (
  SELECT 1 FROM t WHERE (len(words) + 1) * {2 - least} >= size * {least} - 1e-9 AND (len(words) + 1) * {least} <= size * {2 - least} + 1e-9)
  AND list_has_any(words, (SELECT list(DISTINCT x) FROM (SELECT unnest(words) AS x FROM t0)))),
p AS (SELECT unit, doc_id, block, line, {pairs} AS pairs FROM able),
n AS (SELECT *, {numbered} AS bag, len(pairs) AS n FROM p),
d AS (SELECT n.*, name, 2.0::DOUBLE * len(list_intersect(n.bag, t.bag)) / (n.n + t.size) AS dice FROM n JOIN t
  ON n.n * {2 - least} >= size * {least} - 1e-9 AND n.n * {least} <= size * {2 - least} + 1e-9),
r AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY dice DESC, name) AS turn FROM d WHERE dice >= {least})
SELECT doc_id, block::BIGINT AS block, line::BIGINT AS line, name AS license, dice FROM r WHERE turn = 1"""
