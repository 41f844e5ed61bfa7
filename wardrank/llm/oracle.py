"""DuckDB SQL for the operators that SQL can express, over whole tables."""

from __future__ import annotations


def _words(text: str) -> str:
    """The text's words: A-Z lower-cased, runs of digits, letters and non-ASCII."""
    low = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"regexp_extract_all({low}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


ORACLE_SQL: dict[str, str] = {
    "op1_jaccard_join": f"""
WITH RECURSIVE d AS (SELECT doc_id, {_words("text")} AS w FROM documents),
sh AS (
    SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
),
sz AS (SELECT doc_id, COUNT(*) AS n FROM sh GROUP BY doc_id),
pr AS (
    SELECT a.doc_id AS x, b.doc_id AS y, COUNT(*) AS c
    FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
),
lk AS (
    SELECT x, y FROM pr JOIN sz p ON p.doc_id = x JOIN sz q ON q.doc_id = y
    WHERE 5 * c >= 4 * (p.n + q.n - c)
),
cc AS (
    SELECT doc_id, doc_id AS root FROM documents
    UNION
    SELECT lk.y, cc.root FROM cc JOIN lk ON lk.x = cc.doc_id
),
cl AS (SELECT doc_id, MIN(root) AS class_id FROM cc GROUP BY doc_id)
SELECT cl.doc_id, class_id, COUNT(*) OVER (PARTITION BY class_id) AS class_size, coalesce(n, 0) AS n_links
FROM cl LEFT JOIN (SELECT x, COUNT(*) AS n FROM lk GROUP BY x) l ON l.x = cl.doc_id""",
    "op4_decontamination": f"""
WITH d AS (SELECT doc_id, {_words("text")} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, {_words("text")} AS w FROM benchmark),
bw AS (
    SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
    FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i
          FROM b WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
    SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d JOIN sizes ON len(w) >= n)
),
hit AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
pos AS (
    SELECT doc_id, COUNT(DISTINCT p) AS n_hit
    FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id
),
items AS (
    SELECT doc_id, COUNT(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
    FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos ON pos.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id""",
}
