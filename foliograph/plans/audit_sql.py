"""DuckDB SQL of the audit operators, over the derived pages."""

from __future__ import annotations

from ..functions import text as T
from ..operators.audit import FLAGS
from .corpora import PAGES_SQL

# RE2 knows no look-around and takes word edges for ASCII: letters and digits beyond it become '_' where an edge matters
_S = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_STRIP = T.STRIP.replace("'", "''")
_LINES = r"string_split_regex(t, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]')"
_U = "substring(x, 1, 1) IN ('ة', 'ى')"

AUDIT = rf"""{PAGES_SQL},
p0 AS (SELECT path, doc, coalesce(text, '') AS t FROM pages),
p1 AS (
  SELECT *, regexp_replace(t, '[^\x00-\x7f]', '_', 'g') AS ascii_all,
         len(list_filter(string_split_regex(t, '[{_S}]+'), lambda x: x <> '')) AS words,
         len(list_filter({_LINES}, lambda x: regexp_matches(x, '[^{_S}]'))) AS nonempty_lines,
         list_filter(list_transform(regexp_extract_all(t, '[{T.BLOCKS}]{{2,}}'), lambda x: trim(x, '{_STRIP}')),
                     lambda x: length(x) >= 4 AND length(regexp_replace(x, '[^{T.LETTERS}]', '', 'g')) >= greatest(2, floor(0.6::DOUBLE * length(x)))) AS tokens,
         regexp_replace(t, '[^\x00-\x7f]', '_', 'g') AS u
  FROM p0),
p2 AS (
  SELECT *, len(tokens) AS n, len(list_filter(tokens, lambda x: {_U})) AS unlikely,
         CASE WHEN len(tokens) > 0 THEN len(list_filter(tokens, lambda x: starts_with(x, 'ال'))) / len(tokens)::DOUBLE ELSE 0.0::DOUBLE END AS start_al_ratio,
         CASE WHEN len(tokens) > 0 THEN len(list_filter(tokens, lambda x: suffix(x, 'لا'))) / len(tokens)::DOUBLE ELSE 0.0::DOUBLE END AS end_la_ratio,
         CASE WHEN len(tokens) > 0 THEN len(list_filter(tokens, lambda x: {_U})) / len(tokens)::DOUBLE ELSE 0.0::DOUBLE END AS unlikely_start_ratio,
         CASE WHEN nonempty_lines > 0 THEN words / nonempty_lines::DOUBLE ELSE 0.0::DOUBLE END AS words_per_line,
         length(t) - length(replace(t, '"', '')) AS quote_count
  FROM p1),
p3 AS (
  SELECT *, (n >= 15 AND end_la_ratio >= 0.25 AND start_al_ratio <= 0.05) OR (n >= 10 AND unlikely_start_ratio >= 0.15) OR (n >= 20 AND unlikely_start_ratio >= 0.10) AS full_rtl_reversal,
         list_sort(list_distinct(list_concat(regexp_extract_all(u, '\b[a-z]{{2,}}[A-Z]{{1,2}}\b'), regexp_extract_all(u, '\b[A-Z][a-z]{{2,}}[A-Z]{{1,2}}\b'))))[1:15] AS reversed_latin_tokens,
         list_sort(list_distinct(regexp_extract_all(u, '\b0{{2,}}[0-9]+(?:[.,][0-9]+)+\b')))[1:10] AS leading_zero_numbers,
         list_sort(list_distinct(regexp_extract_all(u, '\b[0-9][0-9.,]{{17,}}[0-9]\b')))[1:10] AS long_numeric_runs
  FROM p2),
audit AS (
  SELECT path, doc, CAST(words AS INTEGER) AS words, CAST(nonempty_lines AS INTEGER) AS nonempty_lines, words_per_line,
         CAST(length(regexp_replace(t, '[^{T.LETTERS}]', '', 'g')) AS INTEGER) AS arabic_letters,
         CAST(length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS INTEGER) AS latin_letters,
         CAST(n AS INTEGER) AS long_ar_tokens, start_al_ratio, end_la_ratio, unlikely_start_ratio, full_rtl_reversal,
         NOT full_rtl_reversal AND unlikely_start_ratio >= 0.03 AND unlikely >= 2 AND len(list_filter({_LINES}, lambda y:
           len(list_filter(regexp_extract_all(y, '[\x{{600}}-\x{{6ff}}]{{3,}}'), lambda x: length(x) >= 4 AND {_U})) >= 3 OR
           (len(list_filter(regexp_extract_all(y, '[\x{{600}}-\x{{6ff}}]{{3,}}'), lambda x: length(x) >= 4 AND {_U})) >= 2 AND regexp_matches(y, '[A-Za-z]')))) > 0 AS partial_rtl_corruption,
         regexp_matches(t, '(?:[\x{{600}}-\x{{6ff}}][{_S}]){{4,}}[\x{{600}}-\x{{6ff}}]') AS spaced_letters,
         reversed_latin_tokens, regexp_matches(t, '\)[{_S}]*[^{_S}]{{1,30}}[{_S}]*\(') AS mirrored_parens,
         regexp_matches(t, '»[^\n]{{1,120}}«') AS swapped_guillemets, leading_zero_numbers, long_numeric_runs,
         CAST(quote_count AS INTEGER) AS quote_count, quote_count >= 50 AS many_double_quotes,
         words >= 50 AND words_per_line < 4.0 AS fragmented_lines, len(reversed_latin_tokens) > 0 AS reversed_latin
  FROM p3)"""

_ON = {f: f"len({f}) > 0" if f in ("leading_zero_numbers", "long_numeric_runs") else f for f in FLAGS}
_KEY = {
    "full_rtl_reversal": "end_la_ratio - start_al_ratio",
    "partial_rtl_corruption": "unlikely_start_ratio",
    "reversed_latin": "CAST(len(reversed_latin_tokens) AS DOUBLE)",
    "leading_zero_numbers": "CAST(len(leading_zero_numbers) AS DOUBLE)",
    "long_numeric_runs": "CAST(len(long_numeric_runs) AS DOUBLE)",
    "many_double_quotes": "CAST(quote_count AS DOUBLE)",
    "fragmented_lines": "-words_per_line",
}
FLAGGED = "flagged AS (" + " UNION ALL ".join(f"SELECT '{f}' AS flag, doc, path, {_KEY.get(f, 'CAST(words AS DOUBLE)')} AS key, CAST({'unlikely_start_ratio' if f == 'full_rtl_reversal' else '0.0'} AS DOUBLE) AS second FROM audit WHERE {_ON[f]}" for f in FLAGS) + ")"

SQL = {
    "audit_pages": f"WITH {AUDIT} SELECT * FROM audit",
    "audit_summary": f"WITH {AUDIT} SELECT doc, count(*) AS pages, " + ", ".join(f"count(*) FILTER (WHERE {_ON[f]}) AS {f}" for f in FLAGS) + " FROM audit GROUP BY doc",
    "audit_totals": f"WITH {AUDIT} " + " UNION ALL ".join(f"SELECT '{f}' AS flag, count(*) FILTER (WHERE {_ON[f]}) AS pages FROM audit" for f in FLAGS),
    "audit_flagged": f"WITH {AUDIT}, {FLAGGED} SELECT flag, doc, path, key, second FROM flagged",
    "audit_examples": f"WITH {AUDIT}, {FLAGGED} SELECT flag, CAST(rank AS INTEGER) AS rank, doc, path FROM (SELECT *, row_number() OVER (PARTITION BY flag ORDER BY key DESC, second DESC, path) AS rank FROM flagged) WHERE rank <= 10",
}
