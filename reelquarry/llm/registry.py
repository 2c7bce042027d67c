"""Queries of the training-data operators, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reelquarry.llm.byte_bpe import op5_byte_bpe
from reelquarry.llm.chat import op3_chat
from reelquarry.llm.fingerprints import op1_fingerprints
from reelquarry.llm.html_text import op9_html
from reelquarry.llm.jaccard import op7_jaccard
from reelquarry.llm.langid import op8_language
from reelquarry.llm.media import op2_media
from reelquarry.llm.packing import op6_packing
from reelquarry.llm.suffixes import op10_suffixes
from reelquarry.llm.toxicity import op4_toxicity

CHAT_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
p AS (
  SELECT *, row_number() OVER w - 1 AS i, coalesce(lag(role) OVER w, 'start') AS before,
    replace(replace(replace(text, '\', '\b'), '<turn ', '\o'), '</turn>', '\c') AS esc,
    replace(replace(replace(replace(role, '\', '\b'), '<turn ', '\o'), '</turn>', '\c'), '>', '\g') AS esc_role
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
v AS (SELECT *, before || '>' || role IN
  ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user') AS fine FROM p)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(esc) + length(esc_role) + 15) AS BIGINT) AS formatted_chars,
  CASE WHEN bool_and(fine) THEN max_by(role, i) ELSE 'rejected' END AS state,
  CAST(min(i) FILTER (WHERE NOT fine) AS INTEGER) AS first_invalid_turn
FROM v GROUP BY conv_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_fingerprints": op1_fingerprints,
        "op2_media": op2_media,
        "op3_chat": op3_chat,
        "op4_toxicity": op4_toxicity,
        "op5_byte_bpe": op5_byte_bpe,
        "op6_packing": op6_packing,
        "op7_jaccard": op7_jaccard,
        "op8_language": op8_language,
        "op9_html": op9_html,
        "op10_suffixes": op10_suffixes,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_chat": CHAT_SQL}
