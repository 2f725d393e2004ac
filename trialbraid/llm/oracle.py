"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NGRAM_JOIN = rf"""
WITH RECURSIVE words AS MATERIALIZED (
    SELECT doc_id, regexp_extract_all({_LOWER}, '[^ \x09-\x0D]+') AS w FROM documents
), sets AS MATERIALIZED (
    SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []
        WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
    FROM words
), members AS MATERIALIZED (
    SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets
), links AS MATERIALIZED (
    SELECT a.doc_id AS x, b.doc_id AS y FROM members a JOIN members b USING (shingle)
    WHERE a.doc_id != b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach AS (
    SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
), lowest AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT doc_id, cast(len(s) AS bigint) AS n_shingles, least(doc_id, coalesce(y, doc_id)) AS component_id
FROM sets LEFT JOIN lowest ON x = doc_id
"""

_WORDS = rf"regexp_extract_all({_LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')"

DECONTAMINATION = rf"""
WITH docs AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents),
items AS (
    SELECT item_id, w, least(13, len(w)) AS n
    FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0
), wanted AS MATERIALIZED (
    SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS run
    FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM items)
), runs AS (
    SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS run FROM (
        SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM docs, (SELECT DISTINCT n FROM wanted) WHERE len(w) >= n)
), hits AS MATERIALIZED (SELECT doc_id, i, n, item_id FROM runs JOIN wanted USING (n, run)),
covered AS (
    SELECT doc_id, count(DISTINCT j) AS n_hit
    FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hits) GROUP BY doc_id
), named AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, cast(item_id AS varchar) AS item FROM hits) GROUP BY doc_id
)
SELECT doc_id, cast(len(w) AS bigint) AS n_words, coalesce(n_hit, 0) AS n_hit,
    coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""

RANKED_SEARCH = rf"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS d, doc_id, {_WORDS} AS w FROM documents),
corpus AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, sum(len(w))::bigint AS n_terms FROM docs),
sizes AS MATERIALIZED (
    SELECT d, doc_id, 100 - 50 + (50 * len(w) * n_docs) // n_terms AS m FROM docs, corpus WHERE len(w) > 0
), freq AS MATERIALIZED (SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(w) AS term FROM docs) GROUP BY d, term),
weights AS MATERIALIZED (
    SELECT term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)::double))::bigint AS w
    FROM freq, corpus GROUP BY term, n_docs
), items AS MATERIALIZED (
    SELECT i, item_id, unnest(list_distinct(w)) AS term
    FROM (SELECT row_number() OVER () AS i, item_id, {_WORDS} AS w FROM benchmark)
), scores AS (
    SELECT i, item_id, d, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::bigint AS score
    FROM items JOIN weights USING (term) JOIN freq USING (term) JOIN sizes USING (d)
    GROUP BY i, item_id, d, doc_id
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id ASC NULLS FIRST) AS rank
    FROM scores WHERE score > 0
)
SELECT item_id, rank::integer AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""


def _edit(state: str, cost: str, letter: str, row: str = "''") -> str:
    """SQL: a state (cost, audit, repaired rows) after one more edit."""
    rows = f"{state}.r" if row == "''" else f"CASE WHEN {state}.r = '' THEN {row} ELSE {state}.r || chr(10) || {row} END"
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 'r': {rows}}}"


def _kept(state: str, role: str) -> str:
    return f"CASE WHEN fault NOT IN ('b', 'd') AND role[1] = '{role}' THEN {_edit(state, 'extra', 'K', 'role || chr(58) || text')} END"


def _changed(state: str, role: str) -> str:
    edit = _edit(state, "extra + 3", "R", f"'{role}:' || text")
    return f"CASE WHEN fault NOT IN ('b', 'd') THEN {edit} END"


_GONE = "{'c': 1000000000, 'a': '', 'r': ''}"
#: The states 0 to 3 are: nothing yet, after system, after user, after assistant.
STRUCTURE_REPAIR = rf"""
WITH RECURSIVE bits AS (
    SELECT i, 0 AS k, i::bigint AS c FROM range(256) t(i)
    UNION ALL
    SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END FROM bits WHERE k < 8
), crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
source AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') AS key
    FROM conversations
), numbered AS (
    SELECT s.*, xor(4294967295, list_reduce(
        list_prepend(4294967295::bigint, list_transform(range(1, len(key) + 1), lambda i: ord(key[i])::bigint)),
        lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) % 20 AS damage
    FROM source s, crc
), damaged AS (
    SELECT conv_id, turn, CASE damage WHEN 4 THEN 'user' ELSE role END AS role,
        CASE damage WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
        unnest(CASE damage WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
    FROM numbered WHERE damage != 0
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged
), ordered AS MATERIALIZED (
    SELECT *, CASE
        WHEN NOT regexp_matches(text, '[^ \x09-\x0D]') THEN 'b'
        WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
        WHEN regexp_extract(text, '([^ \x09-\x0D])[ \x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 't'
        ELSE '' END AS fault,
        coalesce(lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] NOT IN ('su', 'ua', 'au'), false) AS illegal
    FROM placed
), steps AS (
    SELECT conv_id, 0::bigint AS i, {{'c': 0, 'a': '', 'r': ''}} AS s0, {_GONE} AS s1,
        {{'c': 3, 'a': 'I', 'r': 'user:'}} AS s2,
        {{'c': 6, 'a': 'II', 'r': 'user:' || chr(10) || 'assistant:'}} AS s3
    FROM (SELECT DISTINCT conv_id FROM conversations)
    UNION ALL
    SELECT conv_id, i, n0, n1, m2, list_min([n3, {_edit("m2", "3", "I", "'assistant:'")}]) FROM (
        SELECT *, list_min([n2, {_edit("n0", "3", "I", "'user:'")}, {_edit("n1", "3", "I", "'user:'")},
            {_edit("n3", "3", "I", "'user:'")}]) AS m2
        FROM (
            SELECT p.conv_id, o.i, CASE fault WHEN 't' THEN 3 ELSE 0 END AS extra,
                {_edit("s0", "4", "D")} AS n0,
                list_min([{_edit("s1", "4", "D")}, {_kept("s0", "s")}]) AS n1,
                list_min([{_edit("s2", "4", "D")}, {_kept("s0", "u")}, {_kept("s1", "u")}, {_kept("s3", "u")},
                    {_changed("s0", "user")}, {_changed("s1", "user")}, {_changed("s3", "user")}]) AS n2,
                list_min([{_edit("s3", "4", "D")}, {_kept("s2", "a")}, {_changed("s2", "assistant")}]) AS n3
            FROM steps p JOIN ordered o ON o.conv_id IS NOT DISTINCT FROM p.conv_id AND o.i = p.i + 1
        )
    )
), last AS (
    SELECT conv_id, max_by(list_min([s0, s3]), i) AS best FROM steps GROUP BY conv_id
), faults AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
        count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
        count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (illegal) AS illegal
    FROM ordered GROUP BY conv_id
)
SELECT l.conv_id, coalesce(gaps, 0)::bigint AS gaps, coalesce(blank, 0) AS blank,
    coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
    coalesce(illegal, 0) AS illegal, best.c::bigint AS cost, best.a AS audit,
    sha256(best.r) AS repaired_sha256
FROM last l LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM l.conv_id
"""
