"""Preference examples from all conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from annolytics.llm.preference import forked_preferences
from annolytics.llm.registry import query, table

RENDER = "array_to_string(list_transform({part}, lambda x: '<|'||coalesce(x.role,'')||'|>'||chr(10)||coalesce(x.text,'')||chr(10)), '')"
# Ranges: the length of all turns before one, and its head, come before its text.
MASK = """array_to_string(list_transform(list_filter(range(1, len({part})+1), lambda i: {part}[i].role = 'assistant'),
    lambda i: (length(""" + RENDER.format(part="{part}[1:i-1]") + """) + length({part}[i].role) + 5) || '-' || length(""" + RENDER.format(part="{part}[1:i]") + """)), ',')"""

OP5_SQL = f"""WITH t AS (SELECT conv_id AS conv, list({{'role': role, 'text': text}} ORDER BY turn, role, text) AS ts FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
  o AS (SELECT *, list_max(list_filter(range(1, len(ts)+1), lambda i: ts[i].role = 'assistant')) AS fork FROM t),
  n AS (SELECT conv, ts, fork, lead(conv) OVER w AS other, lead(ts) OVER w AS nts, lead(fork) OVER w AS nfork FROM o WHERE fork IS NOT NULL
      WINDOW w AS (ORDER BY md5(conv::VARCHAR), conv)),
  p AS (SELECT conv AS pair_id, conv AS chosen, other AS rejected, ts AS c, list_concat(ts[1:fork-1], nts[nfork:]) AS r FROM n WHERE fork > 1 AND other IS NOT NULL),
  b AS (SELECT pair_id, chosen, rejected, c, r, coalesce(list_filter(range(1, least(len(c), len(r))+1),
      lambda i: c[i] IS DISTINCT FROM r[i])[1] - 1, least(len(c), len(r))) AS k FROM p WHERE c IS DISTINCT FROM r),
  s AS (SELECT pair_id, chosen, rejected, k, c[1:k] AS q, c[k+1:] AS c, r[k+1:] AS r FROM b)
  SELECT pair_id, chosen, rejected, k::INTEGER AS prompt_turns, {RENDER.format(part='q')} AS prompt, len(c)::INTEGER AS chosen_turns,
    {RENDER.format(part='c')} AS chosen_text, {MASK.format(part='c')} AS chosen_mask, len(r)::INTEGER AS rejected_turns,
    {RENDER.format(part='r')} AS rejected_text, {MASK.format(part='r')} AS rejected_mask FROM s"""


@query("op5_preference_pairs", OP5_SQL)
def preference_pairs(spark, sf):
    formatted = forked_preferences(table(spark, sf, "conversations"))
    listed = lambda name: F.array_join(F.transform(name, lambda m: F.concat_ws("-", m["start"].cast("string"), m["end"].cast("string"))), ",")
    return formatted.withColumns({name: listed(name) for name in ("chosen_mask", "rejected_mask")})
