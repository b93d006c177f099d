"""SQL for the repair, the manifest and the exact dedup, for DuckDB."""

from __future__ import annotations


def crc32(text: str) -> str:
    """The unsigned crc32 of an ASCII string."""
    codes = f"list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda ch: ord(ch)::BIGINT))"
    bits = "list_reduce(list_prepend(xor(crc, code), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, bit: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce({codes}, lambda crc, code: {bits}), 4294967295)"


EXACT_SQL = r"""
WITH texts AS (SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS normal FROM documents),
ranked AS (
    SELECT *, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY normal) AS group_size, row_number() OVER best AS place
    FROM texts WINDOW best AS (PARTITION BY normal ORDER BY points DESC, doc_id)
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(normal) AS text_sha256 FROM ranked
"""

#: Levels of the trees that the SQL spells out, enough for 16^6 documents a source and as many sources.
DEPTH = 6


def field(value: str) -> str:
    return f"coalesce(strlen(({value})::VARCHAR) || ':' || ({value})::VARCHAR, '-')"


def leaf(text: str) -> str:
    return f"sha256({' || '.join(field(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"


def tree_sql(name: str) -> str:
    """Common table expressions of the levels above ``name``0 (g, i, n, d), with what stands left and right of each node in its run."""
    made = []
    for k in range(DEPTH):
        made.append(f"""
{name}{k}s AS (
    SELECT g, i, n, coalesce(string_agg(d, '') OVER (PARTITION BY g, i // 16 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
        coalesce(string_agg(d, '') OVER (PARTITION BY g, i // 16 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
    FROM {name}{k}
),
{name}{k + 1} AS (SELECT g, i // 16 AS i, (n + 15) // 16 AS n, CASE WHEN n > 1 THEN sha256(string_agg(d, '' ORDER BY i)) ELSE min(d) END AS d FROM {name}{k} GROUP BY g, i // 16, n)""")
    return ",".join(made)


def fold_sql() -> str:
    """Common table expressions from f0 to the table with proof and folded root of each document, level by level."""
    made = []
    for step, (name, k, at) in enumerate([("a", k, "x.i") for k in range(DEPTH)] + [("b", k, "x.place") for k in range(DEPTH)]):
        g = "x.g" if name == "a" else "''"
        made.append(f"""
f{step + 1} AS (
    SELECT x.* EXCLUDE (proof, folded), x.proof || s.l || s.r AS proof, CASE WHEN s.n > 1 THEN sha256(s.l || x.folded || s.r) ELSE x.folded END AS folded
    FROM f{step} x JOIN {name}{k}s s ON s.g = {g} AND s.i = {at} // {16**k}
)""")
    return ",".join(made)


MANIFEST_SQL = f"""
WITH leaves AS (
    SELECT doc_id, coalesce('+' || source, '') AS g, {leaf('text')} AS leaf,
        CASE WHEN {crc32('doc_id::VARCHAR')} % 5 = 0 THEN {leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS other
    FROM documents
),
numbered AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM leaves),
a0 AS (SELECT g, i, n, leaf AS d FROM numbered),{tree_sql('a')},
subroots AS (SELECT g AS name, d, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM a{DEPTH}),
b0 AS (SELECT '' AS g, i, n, d FROM subroots),{tree_sql('b')},
f0 AS (SELECT x.doc_id, x.leaf, x.g, x.i, s.i AS place, s.d AS subroot, '' AS proof, coalesce(x.other, x.leaf) AS folded FROM numbered x JOIN subroots s ON s.name = x.g),{fold_sql()}
SELECT x.doc_id, x.leaf, x.subroot, top.d AS root, sha256(x.proof) AS proof_sha256, x.folded AS folded_root, x.folded = top.d AS verified FROM f{2 * DEPTH} x, b{DEPTH} top
"""

REPAIR_SQL = rf"""
WITH RECURSIVE keyed AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce('+' || conv_id, '') AS g,
        {crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind
    FROM conversations
),
damaged AS (
    SELECT g, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
        CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
    FROM keyed WHERE kind <> 0
),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text), copy) AS i,
        rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS stripped, left(role, 1) AS initial FROM damaged
),
faults AS (
    SELECT *, CASE WHEN stripped = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 THEN 'duplicate'
        WHEN right(stripped, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
        lag(initial) OVER (PARTITION BY g ORDER BY i) || initial AS pair
    FROM placed
),
counts AS (
    SELECT g, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
        count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
        count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal
    FROM faults GROUP BY g
),
moves(s, initial, role, t) AS (VALUES (0, 's', NULL, 1), (0, 'u', 'user', 2), (1, 'u', 'user', 2), (2, 'a', 'assistant', 3), (3, 'u', 'user', 2)),
inserts(s, t, cost, audit, lines) AS (
    SELECT DISTINCT s, s, 0, '', '' FROM moves
    UNION ALL SELECT s, t, 2, 'I', chr(10) || role || ':' FROM moves WHERE role IS NOT NULL
    UNION ALL SELECT a.s, b.t, 4, 'II', chr(10) || a.role || ':' || chr(10) || b.role || ':' FROM moves a JOIN moves b ON a.t = b.s WHERE a.role IS NOT NULL
),
paths(g, i, s, cost, audit, lines) AS (
    SELECT g, 0, 0, 0, '', '' FROM counts
    UNION ALL
    SELECT g, i, s, cost, audit, lines FROM (
        SELECT *, row_number() OVER (PARTITION BY g, s ORDER BY cost, audit) AS best FROM (
            SELECT p.g, p.i + 1 AS i, n.t AS s, p.cost + n.cost + 3 AS cost, p.audit || n.audit || 'D' AS audit, p.lines || n.lines AS lines
            FROM paths p JOIN inserts n ON n.s = p.s JOIN faults f ON f.g = p.g AND f.i = p.i + 1
            UNION ALL
            SELECT p.g, p.i + 1, m.t, p.cost + n.cost + CASE WHEN m.initial = f.initial THEN 0 ELSE 2 END + CASE WHEN f.fault = 'truncated' THEN 1 ELSE 0 END,
                p.audit || n.audit || CASE WHEN m.initial = f.initial THEN 'K' ELSE 'R' END,
                p.lines || n.lines || chr(10) || CASE WHEN m.initial = f.initial THEN f.role ELSE m.role END || ':' || f.text
            FROM paths p JOIN inserts n ON n.s = p.s JOIN faults f ON f.g = p.g AND f.i = p.i + 1 JOIN moves m ON m.s = n.t
            WHERE f.fault NOT IN ('blank', 'duplicate') AND (m.initial = f.initial OR m.role IS NOT NULL)
        )
    ) WHERE best = 1
),
ended AS (
    SELECT p.g, p.cost + n.cost AS cost, p.audit || n.audit AS audit, p.lines || n.lines AS lines,
        row_number() OVER (PARTITION BY p.g ORDER BY p.cost + n.cost, p.audit || n.audit) AS best
    FROM paths p JOIN counts c ON c.g = p.g AND c.n = p.i JOIN inserts n ON n.s = p.s AND n.t IN (0, 3)
),
names AS (SELECT DISTINCT g, conv_id FROM keyed)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
    coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(lines[2:], '')) AS repaired_sha256
FROM names LEFT JOIN counts USING (g) LEFT JOIN (SELECT * FROM ended WHERE best = 1) USING (g)
"""
