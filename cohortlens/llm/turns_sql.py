"""The same repair in SQL, for comparison on small tables.

A forward dynamic program by recursion over a conversation's rows: per state the least cost and,
among equals, the ASCII-least edits. CRC-32 is folded over the key's characters, which are ASCII.
"""

#: state, initial it accepts, state behind
_STEPS = "(0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)"
#: state, state behind, number of inserts, inserted turns
_INSERTS = r"""(0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 1, E'\nuser:'), (1, 2, 1, E'\nuser:'), (2, 3, 1, E'\nassistant:'),
            (3, 2, 1, E'\nuser:'), (0, 3, 2, E'\nuser:\nassistant:'), (1, 3, 2, E'\nuser:\nassistant:')"""


def turns_sql() -> str:
    return rf"""
WITH RECURSIVE cells AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           list_reduce(list_concat([CAST(4294967295 AS BIGINT)],
               list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''),
                              lambda c: CAST(ascii(c) AS BIGINT))),
               lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0],
                                             lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))) AS crc
    FROM conversations),
damaged AS (
    SELECT conv_id, turn, CASE WHEN (4294967295 - crc) % 20 = 4 THEN 'user' ELSE role END AS role,
           CASE (4294967295 - crc) % 20 WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
           unnest(range(CASE WHEN (4294967295 - crc) % 20 = 3 THEN 2 ELSE 1 END)) AS copy
    FROM cells WHERE (4294967295 - crc) % 20 <> 0),
numbered AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i,
           regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS trimmed FROM damaged),
faults AS (
    SELECT conv_id, turn, role, text, i, left(role, 1) AS initial, trimmed = '' AS blank,
           trimmed <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS duplicate,
           trimmed <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) = 1
           AND right(trimmed, 1) NOT IN ('.', '!', '?') AS truncated,
           lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair
    FROM numbered),
counted AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
           count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
           count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
    FROM faults GROUP BY conv_id),
steps(state, initial, next) AS (VALUES {_STEPS}),
inserts(state, next, n, turns) AS (VALUES {_INSERTS}),
edits AS (
    SELECT state, initial, 'K' AS edit, 0 AS cost, next, NULL AS role FROM steps
    UNION ALL SELECT state, NULL, 'R', 2, next, CASE initial WHEN 'u' THEN 'user' ELSE 'assistant' END FROM steps WHERE initial <> 's'
    UNION ALL SELECT s, NULL, 'D', 3, s, NULL FROM range(4) r(s)),
ways AS (
    SELECT conv_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS state, CAST(0 AS BIGINT) AS cost, '' AS audit, '' AS repaired FROM counted
    UNION ALL
    SELECT conv_id, i, state, cost, audit, repaired FROM (
        SELECT w.conv_id, f.i, CAST(e.next AS BIGINT) AS state,
               CAST(w.cost + 2 * p.n + e.cost + CASE WHEN f.truncated AND e.edit <> 'D' THEN 1 ELSE 0 END AS BIGINT) AS cost,
               w.audit || repeat('I', p.n) || e.edit AS audit,
               w.repaired || p.turns || CASE WHEN e.edit = 'D' THEN '' ELSE E'\n' || coalesce(e.role, f.role) || ':' || f.text END AS repaired
        FROM ways w JOIN faults f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1
        JOIN inserts p ON p.state = w.state
        JOIN edits e ON e.state = p.next AND (e.edit = 'D' OR NOT (f.blank OR f.duplicate)) AND (e.initial IS NULL OR e.initial = f.initial))
    QUALIFY row_number() OVER (PARTITION BY conv_id, state ORDER BY cost, audit) = 1),
finished AS (
    SELECT w.conv_id, w.cost + 2 * p.n AS cost, w.audit || repeat('I', p.n) AS audit, w.repaired || p.turns AS repaired
    FROM ways w JOIN counted c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.i
    JOIN inserts p ON p.state = w.state AND p.next IN (0, 3)
    QUALIFY row_number() OVER (PARTITION BY w.conv_id ORDER BY w.cost + 2 * p.n, w.audit || repeat('I', p.n)) = 1)
SELECT o.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate,
       coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal, CAST(coalesce(f.cost, 0) AS BIGINT) AS cost,
       coalesce(f.audit, '') AS audit, sha256(coalesce(substr(f.repaired, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN finished f ON f.conv_id IS NOT DISTINCT FROM o.conv_id
"""
