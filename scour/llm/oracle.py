"""DuckDB SQL for the queries that SQL can express.  Word lists and bounds come from the operators."""

from __future__ import annotations

from . import codes, mixing, rules

WORD = r"[^\x20\x09-\x0D]+"


def _rules() -> str:
    def breaks(r: rules.Rule) -> str:
        sides = [f"{r.measure} < {r.low}"] if r.low is not None else []
        sides += [f"{r.measure} > {r.high}"] if r.high is not None else []
        return f"(({' OR '.join(sides)}) AND n_words >= {r.least})"

    stops = ", ".join(f"'{w}'" for w in dict.fromkeys(rules.STOP_WORDS))

    def ratio(a: str, b: str) -> str:
        return f"CASE WHEN {b} > 0 THEN {a}::DOUBLE / {b} ELSE 0 END"

    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS rid FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{WORD}') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS ls FROM d),
g AS (SELECT rid, i, array_to_string(ws[i:i + 4], ' ') AS gram
      FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM g) WHERE n > 1),
cov AS (SELECT rid, sum(least(5, coalesce(nxt - i, 5)))::BIGINT AS n_repeat_words
        FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM dup) GROUP BY rid),
c AS (SELECT doc_id, len(ws)::BIGINT AS n_words, len(array_to_string(ws, ''))::BIGINT AS word_chars,
             (len(t) - len(translate(t, '{rules.SYMBOLS}', '')))::BIGINT AS n_symbols,
             (len(t) - len(translate(t, '{rules.SHOUTS}', '')))::BIGINT AS n_shouts,
             len(ls) AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
             len(list_filter(ws, lambda x: lower(x) IN ({stops}))) AS n_stops,
             len(list_filter(ls, lambda x: regexp_matches(x, '{rules.BULLET}'))) AS n_bullets,
             len(list_filter(ls, lambda x: regexp_matches(x, '{rules.ELLIPSIS}'))) AS n_ellipses
      FROM w LEFT JOIN cov USING (rid)),
m AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
             {ratio('word_chars', 'n_words')} AS mean_word_chars, {ratio('n_symbols', 'n_words')} AS symbols_per_word,
             {ratio('n_shouts', 'n_words')} AS shouts_per_word, {ratio('n_stops', 'n_words')} AS stop_word_ratio,
             {ratio('n_dup_lines', 'n_lines')} AS dup_line_ratio, {ratio('n_bullets', 'n_lines')} AS bullet_line_ratio,
             {ratio('n_ellipses', 'n_lines')} AS ellipsis_line_ratio FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR {' OR '.join(breaks(r) for r in rules.RULES)}) AS kept FROM m"""


ORACLE = {"op5_quality_rules": _rules(), "op8_mix_sources": mixing.SQL, "op11_vector_codes": codes.sql()}
