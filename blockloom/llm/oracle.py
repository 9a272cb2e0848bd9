"""SQL (as DuckDB runs it) for operators that SQL can express, written apart from their code."""

from __future__ import annotations

from blockloom.llm import url_lists

_BLANK = "concat(chr(32), chr(9), chr(10), chr(11), chr(12), chr(13))"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

LINE_DEDUP = f"""
WITH docs AS (SELECT doc_id, coalesce(string_split(text, chr(10)), ['']) AS ls FROM documents),
windows AS (
  SELECT doc_id, i AS pos, trim(ls[i + 1], {_BLANK}) AS a, trim(ls[i + 2], {_BLANK}) AS b, trim(ls[i + 3], {_BLANK}) AS c
  FROM docs, LATERAL unnest(range(0, len(ls) - 2)) AS u(i)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS place FROM windows WHERE a || b || c <> ''),
gone AS (SELECT DISTINCT doc_id, pos + k AS pos FROM ranked, LATERAL unnest([0, 1, 2]) AS u(k) WHERE place > 1),
every AS (SELECT doc_id, i AS pos, ls[i + 1] AS line FROM docs, LATERAL unnest(range(0, len(ls))) AS u(i))
SELECT e.doc_id, coalesce(string_agg(e.line, chr(10) ORDER BY e.pos) FILTER (WHERE g.pos IS NULL), '') AS text,
  count(g.pos) AS n_removed
FROM every e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.pos = e.pos GROUP BY e.doc_id"""

_SPACES = "(length(line) - length(replace(line, ' ', '')) + 1)"
_PHRASES = (
    r"(?i)\b(all rights reserved|licensed under|released under the|general public license|terms of (use|service)"
    r"|privacy policy|cookie policy|use of cookies|accept cookies|enable javascript|sign in|log in to|subscribe to"
    r"|share this|skip to content|read more)\b|©"
)
_ENDED = """[.!?…。！？]["''”’»)\\]]*(\\s|$)"""


def _count(pattern: str, text: str = "line") -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


LINE_CLEANING = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM docs),
grams AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM words, LATERAL unnest(range(1, len(w) - 1)) AS u(i)),
twice AS (SELECT doc_id, unnest(list(i)) AS i FROM grams GROUP BY doc_id, a, b, c HAVING count(*) > 1),
repeated AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM twice, LATERAL unnest([0, 1, 2]) AS u(k) GROUP BY doc_id),
lines AS (
  SELECT doc_id, line, len({_WORDS.format('line')}) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs)),
judged AS (
  SELECT *, {_count('[|»›•→]')} >= 3
    OR ({_SPACES} <= 25 AND regexp_matches(line, '{_PHRASES}'))
    OR {_count('[#*$%&|<>]')} > 0.1 * {_SPACES} OR {_count('!!')} > 0.3 * {_SPACES}
    OR ({_SPACES} >= 20 AND NOT regexp_matches(line, '{_ENDED}')) AS failed
  FROM lines WHERE n > 0),
by_doc AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines, coalesce(sum(n) FILTER (WHERE failed), 0) AS lost
  FROM judged GROUP BY doc_id),
counted AS (
  SELECT d.doc_id, len(w.w) AS n_words, length(array_to_string(w.w, '')) AS word_chars,
    {_count('[#*$%&|<>]', 'd.text')} AS n_symbols, coalesce(b.n_dup_lines, 0) AS n_dup_lines,
    coalesce(r.n_repeat_words, 0) AS n_repeat_words, coalesce(b.lost, 0) AS lost
  FROM docs d JOIN words w ON w.doc_id = d.doc_id LEFT JOIN by_doc b ON b.doc_id = d.doc_id
    LEFT JOIN repeated r ON r.doc_id = d.doc_id),
based AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, coalesce(word_chars, 0) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND lost <= 0.5 * n_words AS kept
FROM based"""

_MARKS = """.,;:!?"''()[]«»…"""
_OFFSETS = ([0, 1, 3, 6, 7, 9, 10], [0, 1, 2, 4, 5, 7, 9], [0, 2, 3, 4, 7, 8, 9])


def _seeds(table: str, at: str) -> str:
    """Spaced seeds of (id, w): the words at a mask's places, joined."""
    parts = []
    for number, places in enumerate(_OFFSETS):
        joined = " || ' ' || ".join(f"w[i + {p}]" for p in places)
        parts.append(
            f"SELECT id, i - 1 AS {at}, {number} AS mask, {joined} AS seed FROM {table}, LATERAL unnest(range(1, len(w) - {places[-1] - 1})) AS u(i)"
        )
    return " UNION ALL ".join(parts)


DECONTAMINATION = f"""
WITH docs AS (SELECT doc_id AS id, {_WORDS.format(f"lower(translate(text, '{_MARKS}', ''))")} AS w FROM documents),
items AS (
  SELECT * FROM (SELECT item_id AS id, {_WORDS.format(f"lower(translate(text, '{_MARKS}', ''))")} AS w FROM benchmark) WHERE len(w) >= 11),
doc_seeds AS ({_seeds('docs', 'pos')}),
item_seeds AS ({_seeds('items', 'item_at')}),
hits AS (
  SELECT d.id AS doc_id, s.id AS item_id, d.pos, s.item_at FROM doc_seeds d JOIN item_seeds s ON s.seed = d.seed AND s.mask = d.mask),
placed AS (
  SELECT h.*, d.w AS dw, t.w AS iw, least(len(t.w), 20) AS n,
    greatest(0, least(h.item_at - 4, len(t.w) - least(len(t.w), 20))) AS b
  FROM hits h JOIN docs d ON d.id = h.doc_id JOIN items t ON t.id = h.item_id),
agreed AS (
  SELECT doc_id, item_id, n, list_sum(list_transform(range(0, n), lambda k:
    CASE WHEN pos - item_at + b + k >= 0 AND dw[pos - item_at + b + k + 1] = iw[b + k + 1] THEN 1 ELSE 0 END)) AS agree
  FROM placed)
SELECT doc_id, item_id, count(*) AS hits, max(agree / n) AS overlap FROM agreed WHERE agree >= ceil(0.8 * n) GROUP BY doc_id, item_id"""

ORACLE: dict[str, str] = {
    "op4_spaced_seed_decontamination": DECONTAMINATION,
    "op5_window_line_dedup": LINE_DEDUP,
    "op7_line_first_cleaning": LINE_CLEANING,
    "op8_temporal_url_lists": url_lists.ORACLE_SQL,
}
