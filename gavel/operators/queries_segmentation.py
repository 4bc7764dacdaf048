"""Queries of agenda segmentation; the rows before near-equal titles are merged have a DuckDB twin."""

from __future__ import annotations

from gavel.operators import scores, summaries
from gavel.operators import segmentation as S
from gavel.operators.queries_documents import CONTACT, PROCEDURE, quoted
from gavel.operators.queries_scores import human
from gavel.operators.queries_scores import holds as contains_any
from gavel.operators.queries_summaries import noise
from gavel.plans.bridge import Tables, from_sql, twin

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = twin(sql)
        return f

    return add


def lines_of(*parts: str) -> str:
    """SQL of a text of several lines: quoted lines and expressions."""
    return "concat(" + ", chr(10), ".join(p if p.startswith(("text", "replace(", "repeat(")) else quoted(p) for p in parts) + ")"


#: Every document's whole text with pages, numbers, paragraphs, names and ends around it or in all its lines.
BENT = (
    "(SELECT doc_id, CASE doc_id % 12 "
    + " ".join(
        f"WHEN {k} THEN {sql}"
        for k, sql in enumerate(
            [
                lines_of("[PAGE 2]", "1. Subject: Downtown Streetscape Contract", "text", "Vote: Passed 5-0", "[PAGE 3]", "A. Contract expansion for traffic controls", "2. Subject: Annual Work Program", "Recommended Action: Receive it", "text"),
                "replace(text, chr(10), concat(chr(10), '7. Adopt '))",
                "replace(text, chr(10), concat(chr(10), chr(10), 'Review '))",
                lines_of("[PAGE 1]", "1. Approve the Budget Update", "text", "ATTEST:", "IN WITNESS WHEREOF", "City Clerk", "[PAGE 2]", "2. Subject: Never Seen"),
                lines_of("[PAGE 1]", "1. Approve the Budget Update", "Adjournment", "Official Seal, City Clerk", "text", "3. Adopt the Fee Schedule", "[PAGE 2]", "2. Award the Paving Contract"),
                lines_of("1. Subject: Zoning of Oak Lane", "Recommendation: take the following action, which would:", "2. Modify the parking requirements", "text", "3. Subject: Fees for Parks", "4. 12 / 34 $5 #6 7% a", "5. in the appropriate format"),
                lines_of("Public Comment", "1. Maria Lopez", "2. Ana Paz and Jo Smith", "3. Amend the Tree Ordinance", "4. Call to Order", "text"),
                lines_of("City packet Page 3", "text", "again Page 3", "[PAGE 3] Approve x", "1. Approve the mural design", "more [PAGE 4] and Page 5", "text"),
                "replace(text, chr(10), concat(chr(10), '4. 12 $5 | 7% '))",
                lines_of("1. Maria Lopez", "2. Ana Paz", "3. Jo Ann Smith", "4. Lee Chan", "5. Adopt the Noise Rules", "text"),
                "replace(text, chr(10), concat(chr(10), chr(10)))",
            ]
        )
    )
    + " ELSE text END AS text FROM {documents} d)"
)


def found(t):
    # where a text is null the SQL's concat leaves it out
    docs = from_sql(t, "SELECT * FROM " + BENT.replace("{documents}", "(SELECT doc_id, coalesce(text, '') AS text FROM {documents})") + " b")
    return S.judged(S.candidates(S.agenda_pages(S.pages(docs, "doc_id", "text"), "doc_id"), "doc_id"), "doc_id")


def multi(p: str, flags: str = "m") -> str:
    return quoted(f"(?{flags})" + p)


def trimmed(c: str) -> str:
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def collapsed(c: str) -> str:
    return "COLLAPSE(" + c + ")"


def procedural(c: str) -> str:
    return PROCEDURE.replace("title", c)


def contact(c: str) -> str:
    return CONTACT.replace("title", c)


def noise_title(c: str) -> str:
    """c is a collapsed title."""
    low = f"lower({c})"
    words = f"string_split({low}, ' ')"
    return (
        f"(length({c}) < 10 OR {procedural(c)} OR {contact(c)} OR regexp_matches({low}, {quoted('|'.join((*S.NOISE_PATTERNS, summaries.OTHERS[3])))})"
        f" OR CAST(len(list_filter({words}, lambda w: regexp_matches(w, '^\\p{{L}}$'))) AS DOUBLE) / len({words}) >= 0.6 OR regexp_matches({c}, {quoted(S.DATE_LINE)})"
        f" OR (ends_with({low}, ':') AND length({c}) <= 45) OR (contains({low}, 'as follows') AND length({c}) <= 40) OR {contains_any(low, S.NOISE_PHRASES)} OR {noise(low)})"
    )


def person(c: str) -> str:
    """c is any title; the rule stands in a scalar subquery that names its forms."""
    words = "list_filter(regexp_split_to_array(n, '\\s+(?:and|&)\\s+|\\s+'), lambda w: w <> '')"
    joined = f"((contains(lower(n), ' and ') OR contains(n, ' & ')) AND len({words}) BETWEEN 2 AND 8 AND len(list_filter({words}, lambda w: NOT regexp_matches(w, {quoted(S.NAME_WORD)}))) = 0)"
    n = trimmed("regexp_replace(" + collapsed(c) + ", '\\(\\d+\\)', '', 'g')")
    return f"(SELECT n <> '' AND (contains(lower(n), 'on behalf of') OR (NOT regexp_matches(lower(n), {quoted(S.NOT_PERSONS)}) AND ({human(True)} OR {joined}))) FROM (SELECT {n} AS n) one)"


def tabular(parent: str) -> str:
    """Of the columns title and description, and of text and tokens, their collapsed sum and its words."""
    share = "(CAST(len(list_filter(tokens, lambda x: regexp_matches(x, '[0-9$%/|#]'))) AS DOUBLE) / len(tokens))"
    signs = f"(CAST({parent} AND regexp_matches(title, {quoted(scores.SUB_MARKER)}) AS INTEGER) + CAST({share} >= 0.35 AS INTEGER) + CAST(len(tokens) >= 5 AND NOT {contains_any('lower(text)', scores.VERBS)} AS INTEGER))"
    letters = "CAST(length(regexp_replace(text, '[^\\p{L}]+', '', 'g')) AS DOUBLE) / length(text)"
    return f"(text <> '' AND length(text) <= 180 AND ((length(text) <= 150 AND {letters} < 0.6 AND {share} >= 0.25) OR ({parent} AND {signs} >= 2) OR ({signs} >= 3 AND length(text) <= 120)))"


ENDS = "regexp_matches(lower(" + collapsed("L[i]") + "), " + quoted("|".join(S.END_LINES)) + ")"
WINDOW = "lower(concat(array_to_string(L[i:i + 24], chr(10)), chr(10), ahead))"
OK = "(length({0}) >= 3 AND NOT regexp_matches({0}, " + quoted(S.TITLE_ENDS) + ") AND NOT regexp_matches({0}, " + quoted(S.TITLE_LIST).replace("{", "{{").replace("}", "}}") + "))"

PARTS = rf"""
src AS (SELECT doc_id, coalesce(text, '') AS t FROM {BENT} b),
marked AS (
  SELECT doc_id, t, replace(regexp_replace(regexp_replace(t, {quoted("(" + S.PAGE_MARK.replace("(", "(?:") + ")")}, concat(chr(1), '\1'), 'gi'),
    {multi("^(" + S.PAGE_HEAD[1:-1].replace("(", "(?:") + ")$", "im")}, concat(chr(1), '\1'), 'g'), concat(chr(1), chr(1)), chr(1)) AS m FROM src),
piece AS (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS x FROM (SELECT doc_id, list_filter(string_split(m, chr(1)), lambda y, k: y <> '' OR k = 1) AS l FROM marked)),
placed AS (
  SELECT doc_id, row_number() OVER w AS i, x, lag(x) OVER w AS prev, coalesce(lead(x) OVER w, '') AS nxt, sum(length(x)) OVER w - length(x) AS place
  FROM piece WHERE x <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
numbered_piece AS (
  SELECT *, coalesce(nullif(CASE WHEN i = 1 OR ends_with(prev, chr(10)) THEN regexp_extract(concat(x, nxt), {multi(chr(92) + "A" + S.PAGE_HEAD[1:], "im")}, 1) ELSE '' END, ''),
    nullif(regexp_extract(x, {multi("^" + S.PAGE_MARK, "i")}, 1), '')) AS number FROM placed),
keep AS (
  SELECT doc_id, i, place, number AS cur, place AS last, number IS NOT NULL AS kept FROM numbered_piece WHERE i = 1
  UNION ALL
  SELECT n.doc_id, n.i, n.place, CASE WHEN n.number IS NOT NULL AND NOT (coalesce(k.cur, '') = n.number AND n.place - k.last < 120) THEN n.number ELSE k.cur END,
    CASE WHEN n.number IS NOT NULL AND NOT (coalesce(k.cur, '') = n.number AND n.place - k.last < 120) THEN n.place ELSE k.last END,
    n.number IS NOT NULL AND NOT (coalesce(k.cur, '') = n.number AND n.place - k.last < 120)
  FROM keep k JOIN numbered_piece n ON n.doc_id = k.doc_id AND n.i = k.i + 1),
paged AS (
  SELECT doc_id, g - 1 AS page_no, CAST(any_value(cur) AS BIGINT) AS page_number, {trimmed("string_agg(x, '' ORDER BY i)")} AS content
  FROM (SELECT k.*, x, sum(CAST(kept AS INTEGER)) OVER (PARTITION BY k.doc_id ORDER BY k.i) AS g FROM keep k JOIN numbered_piece n ON n.doc_id = k.doc_id AND n.i = k.i) WHERE g > 0 GROUP BY doc_id, g
  UNION ALL SELECT doc_id, 0, 1, t FROM src WHERE doc_id NOT IN (SELECT doc_id FROM keep WHERE kept)),
lined AS (
  SELECT p.*, string_split(content, chr(10)) AS L, (SELECT substring(string_agg(substring(q.content, 1, 2500), chr(10) ORDER BY q.page_no), 1, 2500) FROM paged q WHERE q.doc_id = p.doc_id AND q.page_no >= p.page_no) AS ahead
  FROM paged p),
ending AS (SELECT * FROM (SELECT doc_id, page_no, L, ahead, unnest(range(1, len(L) + 1)) AS i FROM lined) WHERE {ENDS}),
tails AS (
  SELECT doc_id, page_no, i, L, contains(lower({collapsed("L[i]")}), 'adjournment') AS adjourned, {contains_any(WINDOW, S.SUBSTANCE_AFTER)} AS substance
  FROM ending WHERE {" + ".join(f"CAST(contains({WINDOW}, {quoted(w)}) AS INTEGER)" for w in S.LEGAL_TAIL)} >= 2),
later AS (
  SELECT doc_id, page_no, i, bool_or(NOT ({noise_title(collapsed("x"))} OR {person("x")} OR regexp_matches(lower(x), {quoted(S.LEGAL_TITLE)}))) AS goes_on
  FROM (SELECT doc_id, page_no, i, {trimmed("y")} AS x FROM (SELECT doc_id, page_no, i, unnest(regexp_extract_all(array_to_string(L[i + 1:], chr(10)), {multi(S.NUMBERED_BY_DIGITS)}, 1)) AS y FROM tails)) GROUP BY ALL),
stops AS (
  SELECT t.doc_id, t.page_no, min(t.i) AS i FROM tails t LEFT JOIN later l ON l.doc_id = t.doc_id AND l.page_no = t.page_no AND l.i = t.i
  WHERE CASE WHEN adjourned THEN NOT substance ELSE NOT coalesce(goes_on, false) END GROUP BY ALL),
page AS (
  SELECT l.doc_id, l.page_no, l.page_number, CASE WHEN s.i = 1 THEN '' WHEN s.i IS NOT NULL THEN concat(array_to_string(L[1:s.i - 1], chr(10)), chr(10)) ELSE content END AS content
  FROM lined l LEFT JOIN stops s ON s.doc_id = l.doc_id AND s.page_no = l.page_no
  WHERE l.page_no <= coalesce((SELECT min(f.page_no) FROM stops f WHERE f.doc_id = l.doc_id), l.page_no)),
listed_page AS (
  SELECT *, regexp_extract_all(content, {multi(S.NUMBERED)}, 0) AS w, regexp_extract_all(content, {multi(S.NUMBERED)}, 1) AS k,
    regexp_extract_all(content, {multi(S.NUMBERED)}, 2) AS n, regexp_split_to_array(content, {multi(S.NUMBERED)}) AS g FROM page),
line AS (
  SELECT doc_id, page_no, j - 1 AS pos, k[j] AS marker, {trimmed("n[j]")} AS name, g[j + 1] AS block,
    lower(regexp_replace(array_to_string(list_transform(range(1, j + 1), lambda x: concat(g[x], CASE WHEN x < j THEN w[x] ELSE '' END)), ''), '(^|\n)\s*$', '\1')) AS before
  FROM (SELECT *, unnest(range(1, len(w) + 1)) AS j FROM listed_page)),
line_flags AS (SELECT *, {person("name")} AS is_person, {noise_title(collapsed("name"))} AS is_noise FROM line),
how AS (
  SELECT p.doc_id, p.page_no, p.page_number, p.content, coalesce(n, 0) > 0 AND NOT (n >= 4 AND CAST(bad AS DOUBLE) / n >= 0.5) AS by_number,
    (n >= 5 AND CAST(persons AS DOUBLE) / n >= 0.5) OR {contains_any("lower(content)", S.SPEAKERS)} AS names
  FROM page p LEFT JOIN (SELECT doc_id, page_no, count(*) AS n, count(*) FILTER (is_noise) AS bad, count(*) FILTER (is_person) AS persons FROM line_flags GROUP BY ALL) c ON c.doc_id = p.doc_id AND c.page_no = p.page_no),
split_block AS (
  SELECT doc_id, page_no, pos, marker, name, block, is_person, right(before, 500) AS before,
    {trimmed("coalesce(b[1], '')")} AS l1, {trimmed("coalesce(b[2], '')")} AS l2
  FROM (SELECT *, string_split(regexp_replace(block, '^\s+', ''), chr(10)) AS b FROM line_flags)),
one AS (SELECT *, CASE WHEN {OK.format("l1")} THEN concat(' ', l1, CASE WHEN {OK.format("l2")} THEN concat(' ', l2) ELSE '' END) ELSE '' END AS more FROM split_block),
raw_paragraphs AS (
  SELECT doc_id, page_no, regexp_replace(content, '\r\n?', chr(10), 'g') AS raw FROM how WHERE NOT by_number),
blank AS (SELECT *, list_filter(list_transform(regexp_split_to_array(raw, '\n\s*\n'), lambda x: {trimmed("x")}), lambda x: x <> '') AS b FROM raw_paragraphs),
marked_paragraphs AS (
  SELECT *, CASE WHEN len(b) >= 3 THEN b ELSE list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(raw, '(?m)^[^\S\n]+|[^\S\n]+$', '', 'g'), {quoted(chr(92) + "n(" + S.PARAGRAPH_BEGINS + ")")}, concat(chr(10), chr(10), '\1'), 'g'), '\n\s*\n'), lambda x: {trimmed("x")}), lambda x: x <> '') END AS c FROM blank),
paragraph AS (SELECT doc_id, page_no, generate_subscripts(c, 1) - 1 AS pos, unnest(c) AS x FROM (SELECT doc_id, page_no, list_filter(c, lambda x: length(x) BETWEEN 11 AND 999) AS c FROM marked_paragraphs)),
candidate AS (
  SELECT h.doc_id, h.page_no, h.page_number, pos, true AS numbered, marker, name, {collapsed("concat(name, more)")} AS title,
    concat('Agenda section ', marker) AS description, {collapsed("regexp_extract(block, " + multi(S.VOTE, "im") + ", 1)")} AS result, is_person, names,
    contains(before, 'recommendation:') AND (contains(before, 'would:') OR contains(before, 'following action')) AND NOT contains(right(before, 160), 'subject:') AS nested
  FROM how h JOIN one o ON o.doc_id = h.doc_id AND o.page_no = h.page_no WHERE by_number
  UNION ALL
  SELECT h.doc_id, h.page_no, h.page_number, pos, false, NULL, name, {collapsed("name")}, {collapsed("CASE WHEN length(x) > 500 THEN concat(substring(x, 1, 500), '...') ELSE x END")}, '', {person("name")}, false, false
  FROM how h JOIN (SELECT *, regexp_replace({trimmed("string_split(x, chr(10))[1]")}, {quoted(S.PARAGRAPH_NUMBER)}, '') AS name FROM paragraph) p ON p.doc_id = h.doc_id AND p.page_no = h.page_no),
ruled AS (
  SELECT *, numbered AND regexp_matches(marker, {quoted(S.TOP_LEVEL)}) AS top,
    CASE WHEN numbered AND ((is_person AND names) OR {procedural("name")} OR {contact("name")}) THEN 'procedure_or_name'
      WHEN NOT numbered AND (NOT length(name) BETWEEN 11 AND 149 OR {contains_any("lower(name)", S.PARAGRAPH_BLOCKERS)} OR starts_with(lower(name), 'item #') OR is_person) THEN 'paragraph'
      WHEN NOT regexp_matches(title, '[A-Za-z]') OR (NOT regexp_matches(lower(title), {quoted(summaries.pattern(summaries.CUES))}) AND regexp_matches(title, '^[^A-Za-z]*[a-z]')) THEN 'lowercase_fragment' END AS early,
    CASE WHEN {noise("title")} THEN 'notice_fragment' WHEN {noise_title("title")} THEN 'noise' END AS late,
    numbered AND (regexp_matches(upper(marker), {quoted(S.LETTERED)}) OR (regexp_matches(marker, {quoted(S.TOP_LEVEL)}) AND nested)) AS inner_item,
    {collapsed("concat(title, ' ', description)")} AS text, string_split(lower({collapsed("concat(title, ' ', description)")}), ' ') AS tokens FROM candidate),
reasons AS (
  SELECT *, coalesce(early, CASE WHEN {tabular("false")} THEN 'tabular_fragment' END, late) AS first_reason,
    coalesce(CASE WHEN inner_item THEN 'nested_subitem' END, early, CASE WHEN {tabular("true")} THEN 'tabular_fragment' END, late) AS later_reason FROM ruled),
state AS (
  SELECT *, CASE WHEN coalesce(bool_or(top AND first_reason IS NULL) OVER (PARTITION BY doc_id ORDER BY page_no, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) THEN later_reason ELSE first_reason END AS reason FROM reasons),
counted AS (SELECT *, count(*) FILTER (reason IS NULL) OVER (PARTITION BY doc_id, page_no ORDER BY pos) AS items FROM state),
streaks AS (SELECT *, count(*) FILTER (reason IS NOT NULL) OVER (PARTITION BY doc_id, page_no, items ORDER BY pos) AS streak FROM counted),
live AS (
  SELECT *, count(*) FILTER (reason IS NULL) OVER (PARTITION BY doc_id ORDER BY page_no, pos) AS nth FROM (
    SELECT *, max(streak) OVER p AS s, max(items) OVER p AS c FROM streaks WINDOW p AS (PARTITION BY doc_id, page_no ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  WHERE numbered OR NOT (coalesce(s, 0) >= {S.MOST_REJECTS} OR coalesce(c, 0) >= {S.MOST_ON_PAGE}))
"""
REACHED = f"nth < {S.MOST_ITEMS} OR (nth = {S.MOST_ITEMS} AND reason IS NULL)"


@query("WITH RECURSIVE " + PARTS + "SELECT doc_id, CAST(page_no AS BIGINT) AS page_no, page_number, CAST(pos AS BIGINT) AS pos, reason, title, description, result, CASE WHEN reason IS NULL THEN nth END AS item_order FROM live WHERE " + REACHED)
def x14_candidates(t):
    d = found(t)
    return d.select("doc_id", d.page_no.cast("long").alias("page_no"), "page_number", d.pos.cast("long").alias("pos"), "reason", "title", "description", "result", "item_order")


@query("WITH RECURSIVE " + PARTS + "SELECT doc_id, coalesce(reason, 'accepted') AS reason, count(*) AS n FROM live WHERE " + REACHED + " GROUP BY ALL")
def x14_rejections(t):
    return S.rejections(found(t), "doc_id")


@query()
def x14_agenda_items(t):
    return S.segment(from_sql(t, "SELECT * FROM " + BENT + " b"))
