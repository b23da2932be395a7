"""Line-first quality rules and language-model scores over all documents."""

from __future__ import annotations

from annolytics.llm.line_quality import BOILERPLATE, quality_lines
from annolytics.llm.masked_lm import score_documents
from annolytics.llm.registry import query, table

PHRASES = "(" + "|".join(phrase.replace("'", "''") for phrase in BOILERPLATE) + ")"

OP9_SQL = rf"""WITH d AS (SELECT doc_id, coalesce(text,'') AS t, regexp_extract_all(coalesce(text,''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
  b AS (SELECT doc_id, t, ws, len(ws) AS n_words, length(array_to_string(ws,'')) AS word_chars, len(regexp_extract_all(t,'[#*$%&|<>]')) AS n_symbols FROM d),
  ln AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
  lw AS (SELECT doc_id, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ws FROM ln WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
  lv AS (SELECT doc_id, line, length(array_to_string(ws,'')) AS chars, len(ws) AS n, ws,
      regexp_matches(lower(line), '{PHRASES}') OR (len(list_filter(ws, lambda w: regexp_full_match(w,'[|>»·/]+'))) >= 1 AND 100*len(list_filter(ws, lambda w: regexp_full_match(w,'[|>»·/]+'))) >= 20*len(ws))
      OR 100*len(regexp_extract_all(line,'[#*$%&|<>]')) > 30*len(ws)
      OR (len(ws) >= 8 AND upper(line)=line AND lower(line)<>line)
      OR (len(ws) >= 8 AND 100*len(list_filter(ws, lambda w: right(w,1) IN ('!','?'))) > 60*len(ws))
      OR (len(ws) >= 60 AND NOT regexp_matches(line, '[.!?…:;。！？"''”’»)\]]')) AS fails FROM lw),
  la AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines, coalesce(sum(chars) FILTER (WHERE fails), 0) AS lost FROM lv GROUP BY doc_id),
  w AS (SELECT doc_id, unnest(range(1, len(ws)-1)) AS i, ws FROM d WHERE len(ws) >= 3),
  k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i+1], ws[i+2]) AS n FROM w),
  c AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i+1, i+2]) AS p FROM k WHERE n > 1) GROUP BY doc_id),
  m AS (SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, coalesce(n_dup_lines,0)::BIGINT AS n_dup_lines,
      coalesce(n_repeat_words,0)::BIGINT AS n_repeat_words, coalesce(lost,0)::BIGINT AS lost_chars
      FROM b LEFT JOIN la USING (doc_id) LEFT JOIN c USING (doc_id))
  SELECT *, (n_words < 50 OR 100*n_repeat_words > 50*n_words) AS base_failed,
    NOT (n_words < 50 OR 100*n_repeat_words > 50*n_words) AND 100*lost_chars <= 40*word_chars AS kept FROM m"""


@query("op9_line_quality", OP9_SQL)
def line_quality(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = quality_lines(docs, with_text=False)
    return found.select("_rest.doc_id", *[f"_found.{c}" for c in found.schema["_found"].dataType.names])


@query("op10_masked_lm_score")
def masked_lm_score(spark, sf):
    scored = score_documents(table(spark, sf, "documents").select("doc_id", "text"))
    return scored.select("_rest.doc_id", "n_tokens", "score", "mean_score")
