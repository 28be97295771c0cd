"""DuckDB SQL for the numbered queries that SQL can express. The rest is tested against brute force."""

from __future__ import annotations

OP3 = """
WITH t AS (SELECT DISTINCT conv_id AS pair_id, turn, replace(coalesce(role, ''), '<|', '< |') AS role, replace(coalesce(text, ''), '<|', '< |') AS text
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
u AS (SELECT *, row_number() OVER (PARTITION BY pair_id, turn ORDER BY role, text) AS sub FROM t),
a AS (SELECT pair_id, turn AS last_turn, sub AS last_sub, text AS own FROM (
  SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY turn DESC, sub DESC) AS rn FROM u WHERE role = 'assistant') WHERE rn = 1),
n AS (SELECT *, coalesce(lead(own) OVER (ORDER BY pair_id), first_value(own) OVER (ORDER BY pair_id)) AS other FROM a),
c AS (SELECT u.*, other, (turn, sub) = (last_turn, last_sub) AS is_last, text = other AS equal FROM u JOIN n USING (pair_id) WHERE (turn, sub) <= (last_turn, last_sub)),
p AS (SELECT pair_id, count(*) FILTER (NOT is_last OR equal) AS prompt_turns FROM c GROUP BY 1),
r AS (SELECT pair_id, CASE WHEN NOT is_last OR equal THEN 'prompt' ELSE 'chosen' END AS part, turn, sub, role, text FROM c
  UNION ALL SELECT pair_id, 'rejected', turn, sub, 'assistant', other FROM c WHERE is_last AND NOT equal)
SELECT pair_id, part, turn, sub, role, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS rendered, part <> 'prompt' AND role = 'assistant' AS trainable,
  CASE WHEN part <> 'prompt' AND role = 'assistant' THEN 13 + length(role) END AS loss_from,
  CASE WHEN part <> 'prompt' AND role = 'assistant' THEN 23 + length(role) + length(text) END AS loss_to, prompt_turns
FROM r JOIN p USING (pair_id)
"""


OP12 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS lines, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
k AS (SELECT doc_id, t, lines, len(lines) AS n, [CAST('0x' || substr(h, 8 * i + 1, 8) AS UBIGINT) FOR i IN range(4)] AS r FROM d),
c AS (SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 100 THEN 'plain' WHEN r[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (SELECT *, array_to_string(lines[1:a], '') AS prefix, array_to_string(lines[a + 1:b], '') AS middle, array_to_string(lines[b + 1:n], '') AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_preference_prefix": OP3, "op12_fill_in_middle": OP12}
