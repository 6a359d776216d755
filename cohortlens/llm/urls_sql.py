"""The URL filter in DuckDB's SQL."""

from __future__ import annotations

from cohortlens.llm.urls import ORDER, RULES


def _fits(pattern: str) -> str:
    name, slash, rest = pattern.partition("/")
    return f"((host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{slash}{rest}'))"


def urls_sql(cells: int = 800, reach: int = 4) -> str:
    ordered = sorted(RULES, key=lambda r: (-len(r[0]), r[0]))
    choose = lambda k: "CASE " + " ".join(f"WHEN {_fits(r[0])} THEN '{r[k]}'" for r in ordered) + " END"
    levels = []
    for n in range(1, ORDER + 2):
        p = [f"CASE WHEN n_{s} > 0 THEN (l.{s} + kinds_{s} * {'b.p' if n == 1 else f'o.p_{s}'}) / (n_{s} + kinds_{s}) "
             f"ELSE {'b.p' if n == 1 else f'o.p_{s}'} END AS p_{s}" for s in ("yes", "no")]
        before = "CROSS JOIN letters b" if n == 1 else f"JOIN p{n - 1} o ON o.key = substr(l.key, 2)"
        levels.append(f"""
l{n} AS (SELECT substr(gram, {ORDER + 2 - n}, {n}) AS key, substr(key, 1, {n - 1}) AS context, sum(yes)::DOUBLE AS yes, sum(no)::DOUBLE AS no
  FROM counts GROUP BY ALL),
c{n} AS (SELECT context, sum(yes) AS n_yes, sum(no) AS n_no, count(*) FILTER (yes > 0) AS kinds_yes, count(*) FILTER (no > 0) AS kinds_no
  FROM l{n} GROUP BY ALL),
p{n} AS (SELECT l.key, {', '.join(p)} FROM l{n} l JOIN c{n} c ON c.context = l.context {before})""")
    last = f"p{ORDER + 1}"
    return f"""
WITH rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path FROM rest),
urls AS (SELECT DISTINCT host, path, {choose(0)} AS rule, {choose(1)} AS said,
  ('0x' || substr(md5(host || chr(10) || path), 1, 8))::BIGINT % 5 = 0 AS aside FROM split),
spots AS (SELECT *, repeat(chr(2), {ORDER}) || host || path || chr(2) AS line, unnest(range(1, length(host) + length(path) + 2)) AS spot FROM urls),
grams AS (SELECT host, path, rule, said, aside, substr(line, spot, {ORDER + 1}) AS gram FROM spots),
counts AS (SELECT gram, count(*) FILTER (said = 'allow' AND NOT aside) AS yes, count(*) FILTER (said = 'block' AND NOT aside) AS no FROM grams GROUP BY ALL),
letters AS (SELECT 1.0::DOUBLE / greatest(2, count(DISTINCT substr(gram, {ORDER + 1}, 1))) AS p FROM counts),{','.join(levels)},
scored AS (SELECT host, path, rule, said, aside, avg(ln(p_yes) - ln(p_no)) AS score FROM grams JOIN {last} ON key = gram GROUP BY ALL),
cell AS (SELECT greatest(0, least({cells - 1}, floor((score + {reach}) / {2 * reach} * {cells}))) AS cell,
  count(*) FILTER (said = 'allow') AS yes, count(*) FILTER (said = 'block') AS no FROM scored WHERE rule IS NOT NULL AND aside GROUP BY ALL),
sums AS (SELECT coalesce(sum(yes), 0) AS yes, coalesce(sum(no), 0) AS no FROM cell),
steps AS (SELECT -{reach}::DOUBLE AS t, 1.0::DOUBLE AS wrong UNION ALL
  SELECT (cell + 1) / {cells}::DOUBLE * 2 * {reach} - {reach}, sum(c.yes) OVER w / s.yes::DOUBLE + (s.no - sum(c.no) OVER w) / s.no::DOUBLE
  FROM cell c CROSS JOIN sums s WHERE s.yes > 0 AND s.no > 0 WINDOW w AS (ORDER BY cell)),
chosen AS (SELECT CASE WHEN (SELECT yes > 0 AND no > 0 FROM sums) THEN (SELECT t FROM steps ORDER BY wrong, abs(t), t LIMIT 1) ELSE 0 END AS t),
both_kinds AS (SELECT count(DISTINCT said) = 2 AS yes FROM scored)
SELECT page_id, s.host, s.path, rule, coalesce(said, CASE WHEN b.yes AND score < t THEN 'block' ELSE 'allow' END) AS verdict, round(score, 9) AS score
FROM split s JOIN scored USING (host, path) CROSS JOIN chosen CROSS JOIN both_kinds b"""
