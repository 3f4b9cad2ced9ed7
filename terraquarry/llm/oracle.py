"""DuckDB SQL for the queries of this subpackage that SQL can express, by their definitions alone."""

from __future__ import annotations

import string

#: A-Z to a-z, other letters as they are.
_LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"

CHAT = r"""WITH given AS (SELECT conv_id, turn, role, text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
filled AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM given),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM filled),
turns AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY n) AS before,
    length(text) + length(regexp_replace(text, '[^\\#<]', '', 'g')) + length(' </turn>') + 1
      + CASE role WHEN 'system' THEN length('### System: ') WHEN 'user' THEN length('### User: ') WHEN 'assistant' THEN length('### Assistant: ')
        ELSE length('### @: ') + length(role) + length(regexp_replace(role, '[^\\#<@:]', '', 'g')) END AS chars
  FROM numbered),
judged AS (SELECT *, CASE WHEN (before IS NULL AND role IN ('system', 'user')) OR (before IN ('system', 'assistant') AND role = 'user') OR (before = 'user' AND role = 'assistant') THEN NULL
    ELSE coalesce(nullif(role, ''), 'no role') || ' after ' || coalesce(before, 'start') END AS fault FROM turns),
convs AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '') AS loss, sum(chars)::BIGINT AS formatted_chars,
    arg_min(fault, n) FILTER (fault IS NOT NULL) AS met, arg_max(role, n) AS last FROM judged GROUP BY conv_id),
ended AS (SELECT *, coalesce(met, CASE WHEN last NOT IN ('user', 'assistant') THEN 'end after ' || coalesce(nullif(last, ''), 'no role') END) AS fault FROM convs)
SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars, fault IS NULL AS valid, fault FROM ended"""

SUBSTRINGS = """WITH texts AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
windows AS (SELECT doc_id, i, md5(b[i:i + 399]) AS h FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 398)) AS i FROM texts)),
repeated AS (SELECT doc_id, i FROM windows WHERE h IN (SELECT h FROM windows GROUP BY h HAVING count(*) > 1)),
marked AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400, true)::INT AS new FROM repeated),
numbered AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked),
runs AS (SELECT doc_id, min(i) AS first, max(i) + 400 AS past FROM numbered GROUP BY doc_id, run),
cuts AS (SELECT doc_id, first, past FROM runs UNION ALL SELECT doc_id, octet_length(b) + 1, NULL FROM texts),
gaps AS (SELECT doc_id, first, past, coalesce(lag(past) OVER (PARTITION BY doc_id ORDER BY first, past NULLS LAST), 1) AS start FROM cuts),
kept AS (SELECT doc_id, octet_length(b) AS n_bytes, CASE WHEN first > start THEN hex(b[start:first - 1]) ELSE '' END AS piece, first, past FROM gaps JOIN texts USING (doc_id)),
joined AS (SELECT doc_id, any_value(n_bytes) AS n_bytes, count(past) AS n_spans, string_agg(piece, '' ORDER BY first, past NULLS LAST) AS whole FROM kept GROUP BY doc_id)
SELECT doc_id, n_bytes, n_bytes - length(whole) // 2 AS n_removed, n_spans, sha256(unhex(whole)) AS kept_sha256, n_spans > 0 AS cut FROM joined"""

NEARDUP = rf"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM words),
shingles AS (SELECT doc_id, unnest(s) AS g, len(s) AS n FROM sets),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS common
  FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT x, y FROM shared WHERE 100 * common >= 80 * (n + m - common)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, e.y FROM reach r JOIN edges e ON r.other = e.x),
components AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN components USING (doc_id)"""

SQL = {"op3_chat": CHAT, "op5_substrings": SUBSTRINGS, "op7_neardup": NEARDUP}
