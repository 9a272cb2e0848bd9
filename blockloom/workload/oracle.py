"""ANSI SQL (as DuckDB runs it) for the queries, over the same tables.

Flattening is a recursive query over (page, token position) that carries the
stack of open elements.
"""

from __future__ import annotations

# Written by hand, so that a wrong table or pattern of the engine does not pass on both sides.
VOID_TAGS = "area base br col embed hr img input link meta param source track wbr".split()
SPECIAL_TEXT_TAGS = "script style template rt rp".split()
PRESERVE_TAGS = "pre textarea".split()
EXCLUDED = "script style noscript footer nav link meta button".split()
WITH_NAV = [t for t in EXCLUDED if t != "nav"]
SPACES = [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
UNITS = (
    "teaspoon teaspoons tsp tablespoon tablespoons tbsp cup cups ounce ounces oz pound pounds lb lbs gram grams g kilogram"
    " kilograms kg liter liters l ml milliliter milliliters pinch clove cloves slice slices the la un"
).split()
SUFFIXES = ("com", "net", "org", "example.org", "*.ck", "!www.ck")
ITEM_CHARS = 120
DAY = 86_400

ORACLE: dict[str, str] = {}


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


WS = "concat(" + ", ".join(f"chr({c})" for c in SPACES) + ")"
# Digits in the sense of the contract: decimal numbers, superscripts and digits in rings, but no fractions.
DIGIT = r"[\p{Nd}²³¹⁰⁴-⁹₀-₉①-⑨⑴-⑼⒈-⒐⓪⓵-⓽⓿]"


def strip(e: str) -> str:
    return f"trim({e}, {WS})"


def decoded(e: str) -> str:
    """The entities that occur in the pages, with or without semicolon; &amp; last."""
    for name, char in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("lt", "<"), ("gt", ">"), ("nbsp", "\xa0"), ("amp", "&")):
        e = f"regexp_replace({e}, '&{name}(;|\\b)', {_q(char)}, 'g')"
    return e


TOKEN = (
    r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
    r"|<[a-z/!?][^>]*>|(?:[^<]+|<[^a-z/!?<])+|<"
)

_WALK = f"""
toks AS (
  SELECT page_id, unnest(t) AS tok, generate_subscripts(t, 1) AS pos
  FROM (SELECT page_id, regexp_extract_all(html, {_q(TOKEN)}) AS t FROM pages)),
kinds AS (
  SELECT page_id, pos, tok, name,
    CASE WHEN NOT regexp_matches(tok, '^<[a-zA-Z/!?]') THEN 'text'
         WHEN starts_with(tok, '</') THEN 'close'
         WHEN regexp_matches(tok, '^<[!?]') OR name IN ('script', 'style')
              OR list_contains({_list(sorted(VOID_TAGS))}, name) THEN 'skip'
         ELSE 'open' END AS kind
  FROM (SELECT *, lower(regexp_extract(tok, '^</?([a-zA-Z][^\\s/>]*)', 1)) AS name FROM toks)),
walk AS (
  SELECT page_id, CAST(0 AS BIGINT) AS pos, CAST([] AS VARCHAR[]) AS st, CAST([] AS BIGINT[]) AS op FROM pages
  UNION ALL
  SELECT k.page_id, k.pos,
    CASE WHEN k.kind = 'open' THEN list_append(w.st, k.name)
         WHEN k.kind = 'close' AND list_contains(w.st, k.name)
           THEN w.st[1:len(w.st) - list_position(list_reverse(w.st), k.name)]
         ELSE w.st END,
    CASE WHEN k.kind = 'open' THEN list_append(w.op, k.pos)
         WHEN k.kind = 'close' AND list_contains(w.st, k.name)
           THEN w.op[1:len(w.st) - list_position(list_reverse(w.st), k.name)]
         ELSE w.op END
  FROM walk w JOIN kinds k ON k.page_id = w.page_id AND k.pos = w.pos + 1),
raw_nodes AS (
  SELECT k.page_id, k.pos, {decoded('k.tok')} AS raw, w.st, w.op,
    coalesce(list_position(w.st, 'body'), 0) AS body,
    max(CASE WHEN list_contains(w.st, 'body') THEN 1 ELSE 0 END) OVER (PARTITION BY k.page_id) AS has_body
  FROM kinds k JOIN walk w ON w.page_id = k.page_id AND w.pos = k.pos WHERE k.kind = 'text')
"""


def blocks_cte(excluded=EXCLUDED) -> str:
    return f"""WITH RECURSIVE {_WALK},
nodes AS (
  SELECT *, {strip('raw')} AS piece, CASE WHEN list_contains(st, 'li') THEN list_position(st, 'li') END AS li
  FROM raw_nodes WHERE NOT list_has_any(st, {_list(excluded)}) AND (body > 0 OR has_body = 0)),
grouped AS (
  SELECT page_id, coalesce(op[li], -pos) AS g, min(pos) AS pos,
    string_agg(piece, ' ' ORDER BY pos) AS text,
    any_value(CASE WHEN li IS NOT NULL THEN 'li' WHEN len(st) = 0 THEN '[document]' ELSE st[-1] END) AS tag,
    any_value(CAST(coalesce(li, len(st) + 1) - body AS INTEGER)) AS depth,
    any_value(coalesce(op[li], op[-1])) AS opener
  FROM nodes WHERE piece <> '' GROUP BY page_id, coalesce(op[li], -pos)),
blocks AS (
  SELECT g.page_id, CAST(row_number() OVER (PARTITION BY g.page_id ORDER BY g.pos) - 1 AS INTEGER) AS idx,
    CAST(count(*) OVER (PARTITION BY g.page_id) AS INTEGER) AS n_blocks,
    g.text, g.tag, g.depth,
    coalesce(regexp_extract(t.tok, '\\sitemprop\\s*=\\s*"([^"]*)"', 1), '') AS itemprop,
    trim(regexp_replace(coalesce(regexp_extract(t.tok, '\\sclass\\s*=\\s*"([^"]*)"', 1), ''), '\\s+', ' ', 'g')) AS class,
    coalesce(regexp_extract(t.tok, '\\sid\\s*=\\s*"([^"]*)"', 1), '') AS id
  FROM grouped g LEFT JOIN toks t ON t.page_id = g.page_id AND t.pos = g.opener)
"""


def page_text_cte(scope: str) -> str:
    special = f"NOT list_has_any(st, {_list(SPECIAL_TEXT_TAGS)})"
    if scope == "body":
        piece, where = strip("raw"), f"{special} AND body > 0"
        keep = "piece <> ''"
    else:
        blank = "CASE WHEN contains(raw, chr(10)) THEN chr(10) ELSE ' ' END"
        piece = (
            f"CASE WHEN trim(raw, concat(' ', chr(10), chr(9), chr(12), chr(13))) = ''"
            f" AND NOT list_has_any(st, {_list(PRESERVE_TAGS)}) THEN {blank} ELSE raw END"
        )
        where, keep = special, "true"
    return f"""WITH RECURSIVE {_WALK},
page_texts AS (
  SELECT p.page_id, lower(coalesce(string_agg(n.piece, ' ' ORDER BY n.pos), '')) AS page_text
  FROM pages p LEFT JOIN (
    SELECT page_id, pos, piece FROM (SELECT page_id, pos, {piece} AS piece FROM raw_nodes WHERE {where}) WHERE {keep}
  ) n ON n.page_id = p.page_id GROUP BY p.page_id)
"""


N = ITEM_CHARS
LABELS = f"""labels_raw AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
candidates AS (
  SELECT printf('recipe_%05d', doc_id) AS file, doc_id, lines[1] AS title,
    list_filter(lines[2:], lambda i: length(i) <= {N}) AS ingredients,
    list_filter(lines[2:], lambda i: length(i) > {N}) AS directions
  FROM labels_raw),
page_files AS (
  SELECT page_id, url, printf('recipe_%05d', CAST(regexp_extract(url, '^https?://[^/]+/[a-z]+/(\\d+)', 1) AS BIGINT)) AS file
  FROM pages),
page_labels AS (
  SELECT p.page_id, c.title, c.ingredients, c.directions FROM page_files p JOIN candidates c ON c.file = p.file)
"""

DIGITS = f"^{DIGIT}+$"


def cleaned(items: str) -> str:
    return (
        f"list_transform(list_filter(list_transform({items}, lambda i: {strip('i')}),"
        f" lambda i: i <> '' AND NOT regexp_matches(i, {_q(DIGITS)})), lambda i: lower(i))"
    )


def nonblank(items: str) -> str:
    return f"list_transform(list_filter({items}, lambda i: i <> ''), lambda i: lower(i))"


def has_any(text: str, items: str) -> str:
    """Some non-empty item is in the text."""
    return f"len(list_filter({items}, lambda i: i <> '' AND contains({text}, i))) > 0"


def joined(items: str) -> str:
    return f"coalesce(array_to_string({items}, chr(10)), '')"


# -- flattening ---------------------------------------------------------------

ORACLE["html_blocks"] = blocks_cte() + "SELECT page_id, idx, text, tag, depth FROM blocks"
ORACLE["li_blocks"] = blocks_cte(WITH_NAV) + "SELECT page_id, idx, text, depth FROM blocks WHERE tag = 'li'"
ORACLE["block_attrs"] = blocks_cte() + "SELECT page_id, idx, itemprop, class, id FROM blocks"
ORACLE["unreadable_pages"] = blocks_cte() + """SELECT page_id, idx, text, NULL AS reason FROM blocks
UNION ALL SELECT -1 - page_id, NULL, NULL, 'Unreadable HTML' FROM pages WHERE page_id % 5 = 3"""
for _scope in ("body", "document"):
    ORACLE[f"page_text_{_scope}"] = page_text_cte(_scope) + "SELECT page_id, page_text FROM page_texts"

# -- items --------------------------------------------------------------------

for _name, _fn in (("clean_items", cleaned), ("nonblank_items", nonblank)):
    ORACLE[_name] = f"""
SELECT doc_id, {joined('items')} AS items, CAST(len(items) AS INTEGER) AS n
FROM (SELECT doc_id, {_fn("string_split(text, chr(10))")} AS items FROM documents)"""

ORACLE["boilerplate_items"] = f"""
SELECT doc_id, CAST(pos - 1 AS INTEGER) AS pos,
  regexp_matches({strip('line')}, '(?i)^for the ')
  OR regexp_matches({strip('line')}, '(?i)^(calories|fat|saturated fat|carbohydrates|sugar|fiber|protein|sodium|cholesterol)[:\\\\-]\\s*\\d+') AS boilerplate
FROM (SELECT doc_id, pos,
        regexp_replace(regexp_replace(line, '^(The|Der|La|El|Of) ', 'For the '), '^(In|En|Un) ', 'Fat: 3 ') AS line
      FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos
            FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))"""

# -- joins --------------------------------------------------------------------

ORACLE["pair_pages"] = f"""WITH {LABELS}
SELECT c.file, p.page_id, p.url, c.title FROM candidates c JOIN page_files p ON p.file = c.file"""

ORACLE["pair_left"] = f"""WITH {LABELS}
SELECT c.file, p.page_id, c.title FROM candidates c LEFT JOIN page_files p ON p.file = c.file"""

ORACLE["pending_items"] = """
WITH files AS (SELECT doc_id, printf('recipe_%05d', doc_id) AS file FROM documents)
SELECT file, false AS retry_failed FROM files f WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = f.doc_id)
UNION ALL
SELECT file, true FROM files f WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = f.doc_id AND l.quality = 1)"""

_BODY = page_text_cte("body") + f", {LABELS}"
_ITEMS = nonblank("list_concat(l.ingredients, l.directions)")

ORACLE["contains_any"] = _BODY + f"""
SELECT l.page_id, {has_any('t.page_text', _ITEMS)} AS found
FROM page_labels l JOIN page_texts t ON t.page_id = l.page_id"""


def _near(items: str) -> str:
    return (
        f"list_filter(list_transform({items}, lambda i: lower(i)),"
        " lambda i: 2.0 * least(n, length(i)) > 0.8 * (n + length(i)))"
    )


NEAR = f"""{LABELS},
texts AS (
  SELECT *, CASE WHEN regexp_matches(t, {_q(DIGITS)}) THEN 0 ELSE length(t) END AS n
  FROM (SELECT page_id, idx, text, lower({strip('text')}) AS t FROM blocks)),
near AS MATERIALIZED (
  SELECT x.page_id, x.idx, x.text, x.t, x.n, {_near('l.ingredients')} AS ing, {_near('l.directions')} AS dir,
    lower({strip('l.title')}) AS ttl
  FROM texts x JOIN page_labels l ON l.page_id = x.page_id)"""
TITLE_NEAR = "2.0 * least(n, length(ttl)) > 0.8 * (n + length(ttl))"

ORACLE["fuzzy_candidates"] = blocks_cte() + f""", {NEAR}
SELECT page_id, idx, t, {joined('ing')} AS ing_candidates, {joined('dir')} AS dir_candidates,
  CAST(len(ing) AS INTEGER) AS n_ing, CAST(len(dir) AS INTEGER) AS n_dir,
  CASE WHEN {TITLE_NEAR} THEN ttl END AS title_candidate
FROM near"""


def _chars(e: str, char: str, place: str) -> str:
    return f"unnest(string_split({e}, '')) AS {char}, generate_subscripts(string_split({e}, ''), 1) AS {place}"


def _same_run(first: str, step: str, limit: str) -> str:
    """How many characters from a place on are equal, in the direction of step, at most limit."""
    equal = f"lambda q: substr(a, {first.format('i')} {step} q, 1) = substr(b, {first.format('j')} {step} q, 1)"
    return f"coalesce(list_position(list_transform(range(0, {limit}), {equal}), false) - 1, {limit})"


# Matched characters of two texts: the longest common block (first in a, then in b) of characters that are
# not frequent in a long b, grown over frequent ones, then the same left and right of it. A rectangle is the
# part of a and b that is still to be matched; rows with a size are blocks, runs are equal pieces on a diagonal.
SIMILAR = f"""compared AS MATERIALIZED (
  SELECT page_id, idx, kind, a, b FROM (
    SELECT page_id, idx, 1 AS kind, t AS a, unnest(ing) AS b FROM near
    UNION ALL SELECT page_id, idx, 2, t, unnest(dir) FROM near
    UNION ALL SELECT page_id, idx, 3, ttl, t FROM near WHERE {TITLE_NEAR})),
letters AS MATERIALIZED (
  SELECT s, c, count(*) AS n
  FROM (SELECT s, unnest(string_split(s, '')) AS c FROM (SELECT a AS s FROM compared UNION SELECT b FROM compared))
  GROUP BY s, c),
spelled AS MATERIALIZED (
  SELECT p.a, p.b, x.c, x.n FROM (SELECT DISTINCT a, b FROM compared WHERE a <> b) p JOIN letters x ON x.s = p.a),
unequal AS MATERIALIZED (
  SELECT p.a, p.b, row_number() OVER () AS pid FROM spelled p JOIN letters y ON y.s = p.b AND y.c = p.c
  GROUP BY p.a, p.b HAVING 2.0 * sum(least(p.n, y.n)) > 0.8 * (length(p.a) + length(p.b))),
rare AS (
  SELECT pid, c, list(j) AS places
  FROM (SELECT pid, length(b) AS m, {_chars('b', 'c', 'j')} FROM unequal)
  GROUP BY pid, c, m HAVING m < 200 OR count(*) <= m // 100 + 1),
hits AS (
  SELECT x.pid, x.i, unnest(r.places) AS j
  FROM (SELECT pid, {_chars('a', 'c', 'i')} FROM unequal) x JOIN rare r ON r.pid = x.pid AND r.c = x.c),
runs AS MATERIALIZED (
  SELECT pid, d, min(i) AS i, count(*) AS n
  FROM (SELECT pid, i - j AS d, i, i - row_number() OVER (PARTITION BY pid, i - j ORDER BY i) AS g FROM hits)
  GROUP BY pid, d, g),
rects AS (
  SELECT pid, 1 AS alo, length(a) + 1 AS ahi, 1 AS blo, length(b) + 1 AS bhi, 0 AS size FROM unequal
  UNION ALL (
  WITH best AS (
    SELECT r.pid, r.alo, r.ahi, r.blo, r.bhi, min(CASE WHEN x.pid IS NULL THEN {{'n': 0, 'i': r.alo, 'j': r.blo}} ELSE {{
      'n': greatest(x.i, r.alo, r.blo + x.d) - least(x.i + x.n, r.ahi, r.bhi + x.d),
      'i': greatest(x.i, r.alo, r.blo + x.d), 'j': greatest(x.i, r.alo, r.blo + x.d) - x.d}} END) AS k
    FROM rects r LEFT JOIN runs x
      ON x.pid = r.pid AND x.i < least(r.ahi, r.bhi + x.d) AND x.i + x.n > greatest(r.alo, r.blo + x.d)
    WHERE r.alo < r.ahi AND r.blo < r.bhi
    GROUP BY r.pid, r.alo, r.ahi, r.blo, r.bhi),
  longest AS (
    SELECT s.pid, s.alo, s.ahi, s.blo, s.bhi, s.k.i AS i, s.k.j AS j, -s.k.n AS n, u.a, u.b
    FROM best s JOIN unequal u ON u.pid = s.pid),
  grown AS (
    SELECT *, {_same_run('{} - 1', '-', 'least(i - alo, j - blo)')} AS l,
      {_same_run('{} + n', '+', 'least(ahi - i - n, bhi - j - n)')} AS r FROM longest)
  SELECT pid, unnest([alo, i + n + r, 0]), unnest([i - l, ahi, 0]), unnest([blo, j + n + r, 0]),
    unnest([j - l, bhi, 0]), unnest([0, 0, l + n + r])
  FROM grown WHERE l + n + r > 0)),
matched AS (SELECT pid, sum(size) AS m FROM rects GROUP BY pid),
similar_texts AS MATERIALIZED (
  SELECT u.a, u.b FROM unequal u JOIN matched m ON m.pid = u.pid
  WHERE CAST(2 * m.m AS DOUBLE) / (length(u.a) + length(u.b)) > CAST(0.8 AS DOUBLE)),
labelled AS (
  SELECT n.page_id, n.idx, n.text, coalesce(k.label, 'none') AS label
  FROM near n LEFT JOIN (
    SELECT page_id, idx, ['ingredient', 'direction', 'title'][min(kind)] AS label
    FROM compared c WHERE a = b OR EXISTS (SELECT 1 FROM similar_texts s WHERE s.a = c.a AND s.b = c.b)
    GROUP BY page_id, idx) k ON k.page_id = n.page_id AND k.idx = n.idx)"""

ORACLE["fuzzy_label"] = blocks_cte() + f""", {NEAR}, {SIMILAR}
SELECT page_id, idx, text, label FROM labelled"""

HOST = "lower(regexp_replace(regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)', 1), ':\\d*$', ''))"
DOMAINS = f"""suffixes AS (SELECT unnest({_list(SUFFIXES)}) AS s),
hosts AS (SELECT page_id, url, string_split({HOST}, '.') AS parts FROM pages),
tails AS (
  SELECT page_id, k, array_to_string(parts[len(parts) - k + 1:], '.') AS tail, len(parts) AS n
  FROM hosts, LATERAL (SELECT unnest(generate_series(1, len(parts))) AS k)),
longest AS (
  SELECT t.page_id, max(t.k) AS k FROM tails t JOIN suffixes s ON s.s = t.tail GROUP BY t.page_id),
domains AS (
  SELECT h.page_id, h.url,
    CASE WHEN l.k IS NOT NULL AND l.k < len(parts) THEN array_to_string(parts[len(parts) - l.k:], '.') ELSE '' END AS domain
  FROM hosts h LEFT JOIN longest l ON l.page_id = h.page_id)
"""
ORACLE["registered_domain"] = f"WITH {DOMAINS} SELECT page_id, url, domain FROM domains"

CHECKS = f"""checked AS (
  SELECT l.page_id, l.title <> '' AND contains(t.page_text, lower(l.title)) AS title_ok,
    {has_any('t.page_text', cleaned('l.ingredients'))} AS ingredients_ok,
    {has_any('t.page_text', cleaned('l.directions'))} AS directions_ok
  FROM page_labels l JOIN page_texts t ON t.page_id = l.page_id),
validated AS (
  SELECT *, title_ok OR ingredients_ok OR directions_ok AS valid,
    concat_ws(', ', CASE WHEN NOT title_ok THEN 'title missing' END,
      CASE WHEN NOT ingredients_ok THEN 'no ingredients matched' END,
      CASE WHEN NOT directions_ok THEN 'no directions matched' END) AS reasons
  FROM checked)
"""
_DOC = page_text_cte("document") + f", {LABELS}, {CHECKS}"
ORACLE["validate_pages"] = _DOC + (
    "SELECT page_id, title_ok, ingredients_ok, directions_ok, valid, reasons FROM validated"
)

# Beside the pages (kind 0) there are attempts, by the last digit of the page: 3 a blank body, 4 an error
# text, 5 and 6 refused, 7 without href, 8 not fetched. The error text may hold a short item, so it is checked.
_TRIES = """tries AS (
  SELECT page_id AS page, page_id AS key, 0 AS kind, url, file FROM page_files
  UNION ALL SELECT page_id, -1 - page_id, page_id % 10, url, file FROM page_files WHERE page_id % 10 BETWEEN 3 AND 8)
"""
_CHECKED_TRIES = f"""checked AS (
  SELECT r.key AS page_id, r.page, r.kind, r.url, c.title,
    c.title <> '' AND contains(r.page_text, lower(c.title)) AS title_ok,
    {has_any('r.page_text', cleaned('c.ingredients'))} AS ingredients_ok,
    {has_any('r.page_text', cleaned('c.directions'))} AS directions_ok
  FROM (SELECT r.*, CASE WHEN r.kind = 4 THEN 'http 404' ELSE t.page_text END AS page_text
        FROM tries r JOIN page_texts t ON t.page_id = r.page) r
    JOIN candidates c ON c.file = r.file),
"""
_OUTCOMES = _CHECKED_TRIES + CHECKS[CHECKS.index("validated AS"):] + """,
outcomes AS (
  SELECT page_id, page, kind, title, url AS page_url, CASE WHEN kind <> 7 THEN url END AS url,
    CASE WHEN kind IN (3, 7) THEN 'failed' WHEN kind IN (5, 6) THEN 'needs_browser' WHEN kind = 8 THEN 'pending'
         WHEN valid THEN 'valid' ELSE 'failed' END AS status,
    CASE WHEN kind = 7 THEN 'Missing href' WHEN kind IN (5, 6, 8) THEN NULL
         WHEN kind = 3 THEN 'Empty or invalid HTML from both methods'
         WHEN NOT valid THEN reasons END AS reason
  FROM validated)
"""
_OUTCOME_CTE = page_text_cte("document") + f", {LABELS}, {_TRIES}, {_OUTCOMES}"
ORACLE["crawl_outcome"] = _OUTCOME_CTE + "SELECT page_id, url, status, reason FROM outcomes"
ORACLE["browser_domains"] = _OUTCOME_CTE + f""", {DOMAINS},
named AS (
  SELECT o.page_id, o.reason, CASE WHEN o.kind = 7 THEN '' ELSE d.domain END AS domain
  FROM outcomes o JOIN domains d ON d.page_id = o.page),
grown AS (
  SELECT domain FROM named WHERE reason = 'Empty or invalid HTML from both methods' UNION SELECT 'allrecipes.com')
SELECT page_id, domain FROM named WHERE domain IN (SELECT domain FROM grown)"""


def broken(file: str) -> str:
    """The broken line that stands beside every 50th record."""
    return f"""'{{"file": "' || {file} || '", "title": '"""


ORACLE["read_labels"] = f"""WITH {LABELS}
SELECT file, title, {joined('ingredients')} AS ingredients, {joined('directions')} AS directions FROM candidates
UNION ALL
SELECT md5(line), 'Invalid JSON: ' || line, NULL, NULL
FROM (SELECT {broken('file')} AS line FROM candidates WHERE doc_id % 50 = 7)"""
ORACLE["read_label_files"] = f"""WITH {LABELS}
SELECT file, title, {joined('ingredients')} AS ingredients, {joined('directions')} AS directions FROM candidates
WHERE doc_id % 50 <> 7
UNION ALL
SELECT file, 'Invalid JSON: ' || {broken('file')}, NULL, NULL FROM candidates WHERE doc_id % 50 = 7"""
ORACLE["write_corpus"] = _OUTCOME_CTE + """,
numbered AS (
  SELECT page_id, title, row_number() OVER (ORDER BY page_id) - 1 AS out_index FROM outcomes WHERE status = 'valid')
SELECT page_id, title, out_index, printf('recipe_%05d', out_index) AS out_name FROM numbered"""
ORACLE["materialize"] = blocks_cte() + "SELECT page_id, idx, text FROM blocks"

# Four batches. Domains with a blank body in batch 2 are for the browser in batch 3, also for what is still open.
ORACLE["ingest_stream"] = _OUTCOME_CTE + f""", {DOMAINS},
placed AS (
  SELECT CASE WHEN o.kind = 0 THEN printf('recipe_%05d', o.page) ELSE 'recipe_x' || o.page END AS file,
    o.page AS n, o.kind, o.url, o.status, o.reason, CASE WHEN o.kind = 7 THEN '' ELSE d.domain END AS domain,
    CASE WHEN o.kind = 0 THEN [0, 1, 3][o.page % 3 + 1] WHEN o.kind = 3 THEN 2 ELSE o.page % 2 END AS batch
  FROM outcomes o JOIN domains d ON d.page_id = o.page
  UNION ALL
  SELECT 'recipe_d' || doc_id, doc_id, 7, NULL, 'failed', 'Missing href', '', doc_id % 4
  FROM candidates WHERE file NOT IN (SELECT file FROM page_files)),
listed AS (SELECT DISTINCT domain FROM placed WHERE kind = 3),
final AS (
  SELECT file, n, url, domain, batch,
    CASE WHEN domain IN (SELECT domain FROM listed) AND (batch = 3 OR status IN ('pending', 'needs_browser'))
      THEN 'needs_browser' ELSE status END AS status, reason
  FROM placed),
numbered AS (
  SELECT *, CASE WHEN status = 'valid' THEN row_number() OVER (PARTITION BY status ORDER BY batch, file) - 1 END AS out_index
  FROM final)
SELECT file, CASE WHEN status = 'valid' THEN 'processed' ELSE status END AS status, url,
  CASE WHEN status = 'failed' THEN reason END AS reason, domain, out_index
FROM numbered
UNION ALL
SELECT md5(line), 'failed', NULL, 'Invalid JSON: ' || line, NULL, NULL
FROM (SELECT {broken('file')} AS line FROM placed WHERE n % 50 = 7)"""

# -- quality ------------------------------------------------------------------

ORACLE["dup_lines"] = """
SELECT DISTINCT doc_id FROM (
  SELECT doc_id, line, count(*) AS n
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
  WHERE line NOT IN ('', '0') GROUP BY doc_id, line HAVING count(*) > 1)"""

_LACKS = f"NOT ({has_any('t.page_text', _ITEMS)})"
ORACLE["missing_content"] = _BODY + f"""
SELECT DISTINCT l.page_id FROM page_labels l JOIN page_texts t ON t.page_id = l.page_id WHERE {_LACKS}"""

_REPORT = _BODY + f""",
doubled AS (
  SELECT DISTINCT page_id FROM (
    SELECT page_id, item, count(*) AS n FROM (SELECT page_id, unnest(ingredients) AS item FROM page_labels)
    WHERE item NOT IN ('', '0') GROUP BY page_id, item HAVING count(*) > 1)),
missing AS (SELECT l.page_id FROM page_labels l JOIN page_texts t ON t.page_id = l.page_id WHERE {_LACKS}),
report AS (
  SELECT page_id, page_id AS page, 'doubled ingredients' AS reason FROM doubled
  UNION ALL
  SELECT page_id, page_id, 'html missing recipe' FROM missing WHERE page_id NOT IN (SELECT page_id FROM doubled))
"""
ORACLE["cleanup_report"] = _REPORT + "SELECT page_id, page, reason FROM report"
ORACLE["cleanup_counts"] = _REPORT + (
    "SELECT coalesce(reason, 'total') AS reason, count(*) AS n FROM report GROUP BY ROLLUP (reason)"
)
ORACLE["clean_corpus"] = _REPORT + (
    "SELECT page_id, title FROM page_labels WHERE page_id NOT IN (SELECT page_id FROM report)"
)

# -- context, numbering, sampling ---------------------------------------------

_SECTION = f"""marked AS (
  SELECT *, CASE WHEN lower(tag) NOT IN ('h1', 'h2', 'h3', 'h4', 'h5', 'h6') THEN NULL
      WHEN regexp_matches(lower(text), 'the|der') THEN 'ingredient'
      WHEN regexp_matches(lower(text), 'la|que|in') THEN 'direction'
      ELSE '#none' END AS marker
  FROM blocks),
sectioned AS (
  SELECT *, nullif(last_value(marker IGNORE NULLS) OVER (
      PARTITION BY page_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '#none') AS section
  FROM marked)
"""
ORACLE["section_context"] = blocks_cte() + f", {_SECTION} SELECT page_id, idx, section FROM sectioned"
ORACLE["position_ratio"] = blocks_cte() + (
    "SELECT page_id, idx, round(idx / greatest(1, n_blocks - 1), 9) AS position_ratio FROM blocks"
)
ORACLE["assign_ids"] = _OUTCOME_CTE + """,
numbered AS (
  SELECT page_id, 16 + row_number() OVER (ORDER BY page_id) AS out_index FROM outcomes WHERE status = 'valid')
SELECT page_id, out_index, printf('recipe_%05d', out_index) AS out_name FROM numbered"""
ORACLE["rate_limit_plan"] = f"""WITH {DOMAINS}
SELECT domain, page_id, (row_number() OVER (PARTITION BY domain ORDER BY page_id) - 1) * 60 AS wait
FROM domains"""
ORACLE["limit_blocks"] = blocks_cte() + """
SELECT page_id, idx, text FROM blocks WHERE page_id IN (SELECT page_id FROM pages ORDER BY page_id LIMIT 40)
ORDER BY page_id, idx LIMIT 40"""

CLASSES = """classes AS (
  SELECT d.doc_id, CASE WHEN l.quality IS NULL THEN 'none' WHEN l.toxic = 1 THEN 'title'
      WHEN l.quality = 0 THEN 'direction' ELSE 'ingredient' END AS label
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
"""


def hash32(text: str) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT)"


ORACLE["train_test_split"] = f"""WITH {CLASSES}
SELECT doc_id, label,
  CASE WHEN {hash32("concat_ws(':', '42', doc_id)")} < {int(0.2 * 2**32)} THEN 'test' ELSE 'train' END AS part
FROM classes"""

PLAN = f"""{CLASSES},
counts AS (SELECT label, count(*) AS n FROM classes GROUP BY label),
means AS (SELECT avg(n) AS mean_minor, sum(n) AS minors FROM counts WHERE label <> 'none'),
plan AS (
  SELECT label, n, mean_minor, CAST(floor(mean_minor * 0.5) AS BIGINT) AS floor_target,
    CAST(CASE WHEN label = 'none' THEN least(n, minors) ELSE greatest(n, CAST(floor(mean_minor * 0.5) AS BIGINT)) END AS BIGINT) AS target
  FROM counts, means)
"""
ORACLE["class_plan"] = f"WITH {PLAN} SELECT label, n, mean_minor, floor_target, target FROM plan"
ORACLE["balance_classes"] = f"""WITH {PLAN},
ranked AS (
  SELECT c.doc_id, c.label, p.n, p.target,
    row_number() OVER (PARTITION BY c.label ORDER BY md5(concat_ws(':', '42', c.doc_id)), c.doc_id) - 1 AS rank
  FROM classes c JOIN plan p ON p.label = c.label),
draws AS (
  SELECT label, copy, {hash32("concat_ws(':', '42', label, copy)")} % n AS rank
  FROM (SELECT label, n, unnest(range(target)) AS copy FROM plan WHERE label <> 'none' AND target > n))
SELECT doc_id, label, CAST(0 AS BIGINT) AS copy FROM ranked WHERE rank < target AND target <= n
UNION ALL
SELECT r.doc_id, r.label, d.copy FROM draws d JOIN ranked r ON r.label = d.label AND r.rank = d.rank"""

_DEFAULTS = PLAN.replace("* 0.5", "* 0.33").replace("least(n, minors)", "least(n, 3 * minors)")
ORACLE["class_plan_defaults"] = f"WITH {_DEFAULTS} SELECT label, n, mean_minor, floor_target, target FROM plan"
ORACLE["balance_classes_defaults"] = ORACLE["balance_classes"].replace(PLAN, _DEFAULTS)
ORACLE["shuffle_rows"] = f"""WITH {CLASSES}
SELECT doc_id, label, row_number() OVER (ORDER BY md5(concat_ws(':', '42', doc_id)), doc_id) - 1 AS place FROM classes"""
ORACLE["page_files"] = "SELECT page_id, md5(html) AS md5, CAST(length(html) AS INTEGER) AS n_chars FROM pages"

ORACLE["classification_report"] = f"""WITH {CLASSES},
rows AS (
  SELECT c.label AS y, CASE WHEN d.n_chars < 600 THEN 'none' WHEN d.lang = 'en' THEN 'ingredient'
      WHEN d.lang = 'fr' THEN 'direction' ELSE 'extra' END AS p
  FROM classes c JOIN documents d ON d.doc_id = c.doc_id),
names AS (SELECT y AS class FROM rows UNION SELECT p FROM rows),
per AS (
  SELECT n.class, (SELECT count(*) FROM rows WHERE y = n.class AND p = n.class) AS tp,
    (SELECT count(*) FROM rows WHERE y = n.class) AS support, (SELECT count(*) FROM rows WHERE p = n.class) AS predicted
  FROM names n),
scores AS (
  SELECT class, support, tp,
    CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS precision,
    CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall,
    CASE WHEN support + predicted > 0 THEN 2 * tp / (support + predicted) ELSE 0 END AS f1
  FROM per),
report AS (
  SELECT class, precision, recall, f1, support FROM scores
  UNION ALL SELECT 'accuracy', sum(tp) / sum(support), sum(tp) / sum(support), sum(tp) / sum(support), sum(support) FROM scores
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM scores
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
    sum(f1 * support) / sum(support), sum(support) FROM scores)
SELECT class, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1,
  CAST(support AS BIGINT) AS support FROM report"""

# -- features and vectors -----------------------------------------------------

_CI = "lower(class || ' ' || id)"


def word(words) -> str:
    return _q(r"(^|[^\p{L}\p{N}_])(" + "|".join(words) + r")([^\p{L}\p{N}_]|$)")


def flag(condition: str) -> str:
    return f"CAST({condition} AS INTEGER)"


def count_of(char: str) -> str:
    return f"CAST(length(text) - length(replace(text, {_q(char)}, '')) AS INTEGER)"


_FEATURES = blocks_cte() + f""", {_SECTION},
features AS (
  SELECT page_id, idx, text AS raw, tag, depth, CAST(length(text) AS INTEGER) AS text_len,
    regexp_matches(text, {_q('^' + DIGIT)}) AS starts_with_digit, 'None' AS parent_tag,
    CAST(length(text) - length(regexp_replace(text, {_q(DIGIT)}, '', 'g')) AS INTEGER) AS num_digits,
    {flag(f"regexp_matches(lower(text), {word(UNITS)})")} AS contains_unit,
    {count_of(',')} AS comma_count, {count_of('.')} AS dot_count,
    {flag(f"regexp_matches(text, '[0-9]|[½¼¾⅓]') OR regexp_matches(text, {word(('two', 'three', 'four', 'five'))})")} AS contains_quantity_number,
    idx AS element_index, round(idx / greatest(1, n_blocks - 1), 9) AS position_ratio,
    {flag("coalesce(section = 'ingredient', false)")} AS is_under_current_ingredient_section,
    {flag("coalesce(section = 'direction', false)")} AS is_under_current_direction_section,
    {flag(f"regexp_matches({_CI}, 'ad')")} AS class_has_ing_keyword,
    {flag(f"regexp_matches({_CI}, 'step')")} AS class_has_dir_keyword,
    {flag(f"regexp_matches({_CI}, 'a')")} AS class_has_title_keyword
  FROM sectioned)
"""
_NUMBERS = (
    "depth", "text_len", "starts_with_digit", "num_digits", "contains_unit", "comma_count", "dot_count",
    "contains_quantity_number", "element_index", "position_ratio", "is_under_current_ingredient_section",
    "is_under_current_direction_section", "class_has_ing_keyword", "class_has_dir_keyword", "class_has_title_keyword",
)
ORACLE["block_features"] = _FEATURES + "SELECT * FROM features"
ORACLE["dict_vectorize"] = _FEATURES + "\nUNION ALL ".join(
    ["SELECT page_id, idx, 'tag=' || tag AS key, CAST(1 AS DOUBLE) AS value FROM features",
     "SELECT page_id, idx, 'parent_tag=None', CAST(1 AS DOUBLE) FROM features"]
    + [f"SELECT page_id, idx, '{c}', CAST({c} AS DOUBLE) FROM features" for c in _NUMBERS]
)

# Tags that no page has among its first three blocks have no entry.
ORACLE["dict_vectors"] = f"""{_FEATURES}
SELECT page_id, idx, key, value FROM ({ORACLE["dict_vectorize"].removeprefix(_FEATURES)})
WHERE value <> 0 AND (key NOT LIKE 'tag=%' OR key IN (SELECT 'tag=' || tag FROM features WHERE idx < 3))"""

_TERMS = r"""words AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS w FROM documents),
terms AS (
  SELECT doc_id, unnest(w) AS term FROM words
  UNION ALL
  SELECT doc_id, w[i] || ' ' || w[i + 1] FROM words, LATERAL (SELECT unnest(range(1, len(w))) AS i)),
vocab AS (SELECT term, count(*) AS tf FROM terms GROUP BY term ORDER BY tf DESC, term LIMIT 500)
"""
ORACLE["tfidf_vocab"] = f"WITH {_TERMS} SELECT term, tf FROM vocab"
ORACLE["tfidf_weights"] = f"""WITH {_TERMS},
tf AS (SELECT t.doc_id, t.term, count(*) AS tf FROM terms t JOIN vocab v ON v.term = t.term GROUP BY t.doc_id, t.term),
idf AS (
  SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY term),
weighted AS (SELECT tf.doc_id, tf.term, tf.tf * idf.idf AS w FROM tf JOIN idf ON idf.term = tf.term)
SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM weighted"""

# -- records ------------------------------------------------------------------

_BOILERPLATE = (
    "regexp_matches(text, '(?i)^for the ') OR regexp_matches(text, "
    "'(?i)^(calories|fat|saturated fat|carbohydrates|sugar|fiber|protein|sodium|cholesterol)[:\\\\-]\\s*\\d+')"
)
_RECORDS = blocks_cte(WITH_NAV) + f""",
records AS (
  SELECT p.page_id, arg_min(b.text, b.idx) FILTER (WHERE b.tag = 'h1') AS title,
    coalesce(list(b.text ORDER BY b.idx) FILTER (WHERE b.tag = 'li' AND NOT ({_BOILERPLATE})), []) AS ingredients,
    coalesce(list(b.text ORDER BY b.idx) FILTER (WHERE b.tag = 'p'), []) AS directions
  FROM pages p LEFT JOIN blocks b ON b.page_id = p.page_id GROUP BY p.page_id)
"""
ORACLE["extract_records"] = _RECORDS + (
    f"SELECT page_id, title, {joined('ingredients')} AS ingredients, {joined('directions')} AS directions FROM records"
)
ORACLE["records_json"] = _RECORDS + (
    "SELECT page_id, CAST(to_json({'title': title, 'ingredients': ingredients, 'directions': directions}) AS VARCHAR) AS json FROM records"
)

ORACLE["rule_extract_stream"] = ORACLE["extract_records"].replace(blocks_cte(WITH_NAV), blocks_cte())
ORACLE["rule_predictions"] = blocks_cte() + """
SELECT page_id, idx, text, CASE tag WHEN 'h1' THEN 'title' WHEN 'li' THEN 'ingredient' WHEN 'p' THEN 'direction' ELSE 'none' END AS prediction
FROM blocks"""

# -- throttle -----------------------------------------------------------------

_THROTTLE = f"""WITH RECURSIVE chain AS (
  SELECT user_id, min(ts) AS ts FROM events GROUP BY user_id
  UNION ALL
  SELECT c.user_id, (SELECT min(e.ts) FROM events e WHERE e.user_id = c.user_id AND e.ts >= c.ts + to_seconds({DAY}))
  FROM chain c WHERE c.ts IS NOT NULL),
passed AS (
  SELECT c.user_id, min(e.event_id) AS event_id FROM chain c JOIN events e ON e.user_id = c.user_id AND e.ts = c.ts
  GROUP BY c.user_id, c.ts)
"""
ORACLE["throttle_events"] = _THROTTLE + """
SELECT e.user_id, e.event_id, p.event_id IS NOT NULL AS accepted
FROM events e LEFT JOIN passed p ON p.user_id = e.user_id AND p.event_id = e.event_id"""
ORACLE["throttle_stream"] = _THROTTLE + "SELECT user_id, event_id FROM passed"

# -- training -----------------------------------------------------------------

ORACLE["train_counts"] = blocks_cte() + f""", {LABELS},
parts AS (
  SELECT b.page_id, CASE WHEN {hash32("concat_ws(':', '42', b.page_id, b.idx)")} < {int(0.2 * 2**32)} THEN 'test' ELSE 'train' END AS part
  FROM blocks b WHERE b.page_id IN (SELECT page_id FROM page_labels))
SELECT part, count(*) AS n, count(DISTINCT page_id) AS pages FROM parts GROUP BY part"""
