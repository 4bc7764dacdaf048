"""Queries of a model's summaries made plain, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from gavel.operators import bluf, summaries
from gavel.operators.queries_documents import listed, quoted
from gavel.operators.titles import CLAIM_STOP_WORDS
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


#: An answer of a model for every document, in each of the shapes that the rules know, and the document as its source.
ANSWERS = """(SELECT doc_id, CASE WHEN doc_id % 23 = 4 THEN '' ELSE text END AS source, CASE doc_id % 12
    WHEN 0 THEN concat('Sure, here it is.', chr(10), chr(10), 'Here is a summary of the minutes:', chr(10), '* **Agenda:** Teleconference by Zoom', chr(10), '* **Action:** ', substring(text, 1, 90), chr(10), '* **Vote:** All Ayes.')
    WHEN 1 THEN ''
    WHEN 2 THEN NULL
    WHEN 3 THEN concat('Okay', chr(10), 'Here is the Executive Summary', chr(10), 'Summary of the meeting on Monday', chr(10), 'Join by phone: 510-555-1234')
    WHEN 4 THEN concat('I understand. BLUF: ', substring(text, 1, 400), chr(10), chr(10), '- ', substring(text, 401, 60), chr(10), '- Launch a lunar mining initiative next quarter.', chr(10), '2) ', substring(text, 461, 60), chr(10), '- ', substring(text, 521, 70))
    WHEN 5 THEN concat('BLUF:', chr(10), '1. ', substring(text, 1, 60), chr(10), '2. ', substring(text, 61, 60), chr(10), '2. ', lower(substring(text, 61, 60)))
    WHEN 6 THEN concat('BLUF: Main takeaway', chr(10), '- alpha zeppelin', chr(10), '- bravo zeppelin', chr(10), '- charlie zeppelin', chr(10), '- delta zeppelin', chr(10), '- ', substring(text, 1, 40), chr(10), '- echo zeppelin', chr(10), '- foxtrot zeppelin', chr(10), '- ', substring(text, 41, 50), chr(10), '- ', substring(text, 91, 50))
    WHEN 7 THEN concat('BLUF: Please raise hand to speak.', chr(10), '__First__ ', substring(text, 30, 60), chr(10), '`Second` ', substring(text, 90, 60))
    WHEN 8 THEN concat('BLUF: Nothing of this is held, by the source', chr(10), '- Quixotic zeppelin voyages.')
    ELSE text END AS summary FROM (SELECT doc_id, coalesce(text, '') AS text FROM {documents}) d)"""

LINE_END = quoted(r"\r\n|[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]")
ATTENDS = lambda c: f"regexp_matches(lower(trim({c})), " + quoted("|".join(summaries.LINKS) + "|" + summaries.pattern(summaries.ATTENDANCE)) + ")"
BARE = lambda c: f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
PLAIN = r"regexp_replace(regexp_replace(regexp_replace(line, '\*\*(.+?)\*\*', '\1', 'g'), '__(.+?)__', '\1', 'g'), '`([^`]+)`', '\1', 'g')"
TOKENS = lambda c: f"regexp_extract_all(lower({c}), '[a-z0-9'']+')"
UNMARKED = r"regexp_replace(source, '(?i)\[PAGE\s+\d+\]\s*', ' ', 'g')"

NORMALIZED = (
    # lines that stay, numbered; equal ones once
    "WITH a AS (SELECT * FROM " + ANSWERS + " a), l0 AS (SELECT doc_id, generate_subscripts(ls, 1) AS pos, " + BARE("unnest(ls)") + " AS line FROM (SELECT doc_id, regexp_split_to_array(summary, " + LINE_END + ") AS ls FROM a WHERE summary <> '') s), "
    "l1 AS (SELECT doc_id, pos, " + BARE("regexp_replace(" + BARE("regexp_replace(" + BARE(PLAIN) + r", '^\s*[*\-\x{2022}]+\s*', '')") + r", '^\s*\d+\s*[.)]\s*', '')") + " AS line FROM l0 "
    "WHERE line <> '' AND NOT (starts_with(lower(line), 'here') AND contains(lower(line), 'summary')) AND NOT contains(lower(line), 'executive summary') AND NOT starts_with(lower(line), 'summary of the meeting')), "
    "l2 AS (SELECT * FROM l1 WHERE line <> '' AND NOT " + ATTENDS("line") + " QUALIFY row_number() OVER (PARTITION BY doc_id, lower(trim(line)) ORDER BY pos) = 1), "
    # the bottom line
    "b0 AS (SELECT doc_id, " + BARE("substring(max_by(line, pos) FILTER (starts_with(lower(line), 'bluf:')), 6)") + " AS named, min_by(line, pos) FILTER (NOT starts_with(lower(line), 'bluf:')) AS first, min_by(line, pos) AS whole, count(*) AS n FROM l2 GROUP BY 1), "
    "b1 AS (SELECT doc_id, n, CASE WHEN coalesce(named, '') <> '' THEN named ELSE coalesce(first, whole) END AS t FROM b0), "
    "b2 AS (SELECT doc_id, n, " + BARE("coalesce(nullif(regexp_extract(t, '^(.+?[.!?])(\\s|$)', 1), ''), t)") + " AS t FROM b1), "
    "b3 AS (SELECT doc_id, n, CASE WHEN len(regexp_split_to_array(t, '\\s+')) > 30 THEN concat(rtrim(array_to_string(regexp_split_to_array(t, '\\s+')[:30], ' '), '.,;:'), '.') ELSE t END AS t FROM b2), "
    "b4 AS (SELECT doc_id, n, CASE WHEN t <> '' AND NOT regexp_matches(t, '[.!?]$') THEN concat(rtrim(t, '.,;:'), '.') ELSE t END AS t FROM b3), "
    "b AS (SELECT doc_id, n, CASE WHEN " + ATTENDS("t") + " THEN 'Key meeting takeaway is unclear from extracted text.' ELSE t END AS t FROM b4), "
    # bullets and how far the source holds them
    "u AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM l2 WHERE NOT starts_with(lower(line), 'bluf:')), tok AS (SELECT DISTINCT doc_id, unnest(" + TOKENS("source") + ") AS token FROM a), pre AS (SELECT DISTINCT doc_id, substring(token, 1, 5) AS token FROM tok WHERE length(token) >= 5), "
    "w AS (SELECT doc_id, k, token FROM (SELECT doc_id, k, unnest(" + TOKENS("line") + ") AS token FROM u) x WHERE length(token) >= 3 AND token NOT IN " + listed(CLAIM_STOP_WORDS) + "), "
    "m AS (SELECT w.doc_id, w.k, avg(CAST(tok.token IS NOT NULL OR pre.token IS NOT NULL AS INTEGER)) AS share FROM w LEFT JOIN tok ON tok.doc_id = w.doc_id AND tok.token = w.token LEFT JOIN pre ON pre.doc_id = w.doc_id AND length(w.token) >= 5 AND pre.token = substring(w.token, 1, 5) GROUP BY 1, 2), "
    "v AS (SELECT u.doc_id, u.k, u.line, coalesce(share, 1.0) >= 0.45 OR u.doc_id NOT IN (SELECT doc_id FROM tok) AS held FROM u LEFT JOIN m ON m.doc_id = u.doc_id AND m.k = u.k), "
    "f AS (SELECT *, held AND k <= 7 AS early, count(*) FILTER (held AND k <= 7) OVER (PARTITION BY doc_id) AS n_early FROM v), g AS (SELECT *, row_number() OVER (PARTITION BY doc_id, early ORDER BY k) AS nth FROM f), "
    "kept AS (SELECT g.doc_id, string_agg(concat('- ', line), chr(10) ORDER BY CASE WHEN early THEN 0 ELSE 1 END, k) AS bullets FROM g JOIN b ON b.doc_id = g.doc_id WHERE early OR (held AND n_early < 3 AND b.n >= 3 AND nth <= 3 - n_early) GROUP BY 1), "
    # passages of the source where none is left
    "s AS (SELECT a.doc_id, substring(COLLAPSE(" + UNMARKED + "), 1, 200) AS snippet FROM a), p0 AS (SELECT doc_id, generate_subscripts(ps, 1) AS pos, " + BARE("unnest(ps)") + " AS part FROM (SELECT doc_id, regexp_split_to_array(regexp_replace(" + UNMARKED.replace("' ', 'g'", "chr(10), 'g'") + ", '\\s+', ' ', 'g'), '\\b\\d+\\.\\s+') AS ps FROM a) x), "
    "p1 AS (SELECT * FROM p0 WHERE length(part) >= 12 AND NOT " + ATTENDS("part") + " QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY pos) <= 7), p2 AS (SELECT * FROM p1 QUALIFY row_number() OVER (PARTITION BY doc_id, lower(trim(part)) ORDER BY pos) = 1), p AS (SELECT doc_id, string_agg(concat('- ', part), chr(10) ORDER BY pos) AS bullets FROM p2 GROUP BY 1) "
    "SELECT a.doc_id, CASE WHEN a.summary IS NULL OR a.summary = '' THEN a.summary WHEN b.t IS NULL THEN concat('BLUF: Summary unavailable from extracted text.', chr(10), '- ', CASE WHEN snippet = '' THEN 'Summary unavailable.' ELSE snippet END) "
    "ELSE concat('BLUF: ', b.t, chr(10), coalesce(kept.bullets, p.bullets, concat('- ', CASE WHEN snippet = '' THEN 'Summary unavailable from extracted text.' ELSE snippet END))) END AS normalized FROM a LEFT JOIN b ON b.doc_id = a.doc_id LEFT JOIN kept ON kept.doc_id = a.doc_id LEFT JOIN s ON s.doc_id = a.doc_id LEFT JOIN p ON p.doc_id = a.doc_id"
)


@query(NORMALIZED)
def x17_bluf_summaries(t):
    return bluf.bluf_summaries(from_sql(t, "SELECT * FROM " + ANSWERS + " a")).select("doc_id", "normalized")
