"""DuckDB SQL for the operators' queries that SQL can express, on the whole tables."""

from __future__ import annotations

_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _base32(hexadecimal: str) -> str:
    """Five hexadecimal digits are four digits of base 32."""
    groups = [f"CAST('0x' || substr({hexadecimal}, {5 * i + 1}, 5) AS INTEGER)" for i in range(8)]
    return " || ".join(f"substr('{_ALPHABET}', (({g} >> {shift}) & 31) + 1, 1)" for g in groups for shift in (15, 10, 5, 0))


def _escaped_length(column: str) -> str:
    return f"(length({column})" + "".join(f" + length({column}) - length(replace({column}, '{c}', ''))" for c in ("\\", "<", "[")) + ")"


OP2 = f"""
WITH RECURSIVE words AS (SELECT doc_id, list_filter(string_split_regex(coalesce({_LOWER}, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words),
classes AS (SELECT min(doc_id) AS c, list_sort(s) AS s, len(any_value(s)) AS n FROM sets WHERE len(s) > 0 GROUP BY list_sort(s)),
flat AS (SELECT c, n, unnest(s) AS g FROM classes),
linked AS (SELECT a.c AS x, b.c AS y FROM flat a JOIN flat b ON a.g = b.g AND a.c < b.c AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
both_ways AS (SELECT x, y FROM linked UNION ALL SELECT y, x FROM linked),
reach AS (SELECT c AS x, c AS y FROM classes UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x),
roots AS (SELECT x, min(y) AS root FROM reach GROUP BY x),
named AS (SELECT c.s, r.root FROM classes c JOIN roots r ON r.x = c.c)
SELECT d.doc_id, CAST(len(d.s) AS BIGINT) AS n_shingles, coalesce(n.root, d.doc_id) AS component_id, d.doc_id = coalesce(n.root, d.doc_id) AS kept FROM sets d LEFT JOIN named n ON n.s = list_sort(d.s)
"""

OP4 = f"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
placed AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
  sum(12 + {_escaped_length('role')} + length(role) - length(replace(role, chr(10), '')) + 1 + {_escaped_length('text')} + 11) OVER (w ROWS UNBOUNDED PRECEDING) AS so_far
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(so_far) FILTER (role = 'assistant' OR i = n) AS BIGINT) AS formatted_chars
FROM placed GROUP BY conv_id
"""

OP5 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT html, min(page_id) AS first_id FROM p GROUP BY html)
SELECT page_id, CAST(strlen(p.html) AS BIGINT) AS payload_bytes, {_base32('h')} AS payload_digest,
  CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first_id THEN first_id END AS refers_to
FROM p JOIN f ON p.html = f.html
"""

_HEX = "CAST('0x' || substr(h, {at}, 8) AS BIGINT)"
OP13 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS u, sha256('42:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
c AS (SELECT doc_id, text, u, len(u) AS n, {_HEX.format(at=1)} % (len(u) + 1) AS x, {_HEX.format(at=9)} % (len(u) + 1) AS y,
  CASE WHEN h IS NULL OR text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR {_HEX.format(at=17)} % 100 >= 50 THEN 'plain' WHEN {_HEX.format(at=25)} % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT doc_id, text, n, form, array_to_string(u[1:least(x, y)], '') AS pre, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS mid, array_to_string(u[greatest(x, y) + 1:n], '') AS suf FROM c),
o AS (SELECT *, CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE text END AS output FROM p)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(output) AS output_sha256, sha256(text) AS restored_sha256 FROM o
"""


def _rounds(number: int) -> str:
    """Each round: distances to all centroids, the nearest (of equal ones the lowest number), floors of the exact means."""
    out = []
    for i in range(number + 1):
        out.append(f"a{i} AS MATERIALIZED (SELECT r, v.x, c, list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - m[i]) * (v.x[i] - m[i]))) AS d FROM v CROSS JOIN c{i} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)")
        if i < number:
            out.append(f"s{i} AS (SELECT c, i, sum(x[i]) AS s, count(*) AS n FROM a{i} CROSS JOIN range(1, 65) AS t(i) GROUP BY c, i)")
            out.append(f"m{i} AS (SELECT c, list(CAST((s - (s % n + n) % n) // n AS BIGINT) ORDER BY i) AS m FROM s{i} GROUP BY c)")
            out.append(f"c{i + 1} AS MATERIALIZED (SELECT c{i}.c, coalesce(m{i}.m, c{i}.m) AS m FROM c{i} LEFT JOIN m{i} ON c{i}.c = m{i}.c)")
    return ",\n".join(out)


OP12 = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: CAST(floor(64 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)), x) - 1 AS c, x AS m FROM v WHERE vec_id IS NOT NULL QUALIFY c < 16),
{_rounds(3)}
SELECT vec_id, CAST(a3.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a3.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a3 JOIN v ON a3.r = v.r JOIN c3 ON a3.c = c3.c
"""
