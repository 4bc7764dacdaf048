"""Queries of repaired texts, deterministic summaries and run evidence with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from gavel.functions.text import collapse
from gavel.operators import evidence, repair, scores, summaries, titles
from gavel.operators.queries_documents import PAGES, REASON, listed, matches, pages, quoted, reason
from gavel.operators.queries_scores import ITEMS
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


#: Every document behind headings in broken or spaced capitals.
BROKEN = """(SELECT doc_id, concat(CASE doc_id % 6 WHEN 0 THEN concat('P R O C L A M A T I O N  O F', chr(10), 'T H E CITY') WHEN 1 THEN 'ANN OT ATE D AG EN DA SPE CI AL' WHEN 2 THEN 'S P E C I A L and THE CI TY CO UN CIL MEE TI NG' WHEN 3 THEN 'PL AN NI NG 510-555-1234 CO MM' WHEN 4 THEN concat('See https://a.example/x or www.b.example [Page 3] HTTP x  ', chr(10), chr(10), chr(10), chr(10), chr(10), 'ZO NI NG BO AR D') ELSE '' END, chr(10), coalesce(text, '')) AS text FROM {documents} d)"""
LINES = "(SELECT doc_id, generate_subscripts(l, 1) - 1 AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM " + BROKEN + " b) s)"
CAPS = "list_filter(regexp_split_to_array(line, '\\s+'), lambda w: regexp_matches(w, '^[A-Z]{1,6}$'))"


@query(
    "WITH c AS (SELECT doc_id, line_no, line, " + CAPS + " AS c, len(list_filter(regexp_split_to_array(line, '\\s+'), lambda w: w <> '')) AS n, regexp_replace(line, '[^A-Za-z]', '', 'g') AS letters FROM " + LINES + " l), "
    "s AS (SELECT *, CASE WHEN len(c) >= 3 THEN least(1.0, CAST(0.45 AS DOUBLE) * len(list_filter(c, lambda w: length(w) <= 2)) / len(c) + CAST(0.25 AS DOUBLE) * len(list_filter(c, lambda w: length(w) <= 1)) / len(c) + CAST(0.3 AS DOUBLE) * len(c) / n + CASE WHEN len(c) >= 6 THEN CAST(0.2 AS DOUBLE) ELSE 0 END) ELSE 0 END AS score FROM c) "
    "SELECT doc_id, line_no, round(score, 6) AS score, length(line) <= 220 AND NOT regexp_matches(line, " + quoted(repair.UNSAFE) + ") AND length(letters) >= 8 AND CAST(length(regexp_replace(letters, '[^A-Z]', '', 'g')) AS DOUBLE) / greatest(1, length(letters)) >= 0.8 AND score >= 0.5 AS repairable FROM s"
)
def x7_fragment_scores(t):
    d = from_sql(t, "SELECT * FROM " + BROKEN + " b").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return d.select("doc_id", "line_no", F.round(repair.fragment_score(F.col("line")), 6).alias("score"), repair.is_repairable(F.col("line")).alias("repairable"))


@query()
def x7_repaired_text(t):
    return repair.repair_text(from_sql(t, "SELECT * FROM " + BROKEN + " b")).select("doc_id", "repaired")


@query()
def x8_topic_text(t):
    d = repair.repair_text(from_sql(t, "SELECT * FROM " + BROKEN + " b"))
    return d.select("doc_id", repair.topic_text(F.col("repaired")).alias("topic_text"))


@query()
def u18_reextracted(t):
    old = from_sql(t, "SELECT doc_id + 1 AS catalog_id, CASE WHEN doc_id % 2 = 0 THEN substring(text, 1, 120) ELSE text END AS content, CASE WHEN doc_id % 13 = 0 THEN 'placeholder' WHEN doc_id % 17 = 0 THEN NULL ELSE 'a.pdf' END AS location, CAST(doc_id % 3 AS INT) AS attempts FROM {documents} d")
    new = pages(t).filter("doc_id % 7 <> 0").select((F.col("doc_id") + 1).alias("catalog_id"), F.when(F.col("doc_id") % 5 != 0, F.col("text")).alias("text"))
    return repair.reextracted(old, new, 800)


T0, D0 = "regexp_replace(coalesce(title, ''), '^\\s+|\\s+$', '', 'g')", "regexp_replace(coalesce(description, ''), '^\\s+|\\s+$', '', 'g')"
LOW_LINE = "lower(trim({}))"


def noise(c: str) -> str:
    low = LOW_LINE.format(c)
    return (
        "(regexp_matches(" + low + ", " + quoted("|".join(summaries.LINKS) + "|" + summaries.pattern(summaries.ATTENDANCE) + "|" + summaries.pattern(summaries.FRAGMENTS) + "|" + "|".join(summaries.OTHERS)) + ") OR regexp_matches(regexp_replace(" + low + ", '[^a-z0-9]+', '', 'g'), "
        + quoted(summaries.pattern(summaries.compact(summaries.FRAGMENTS))) + ") OR (contains(" + low + ", 'you may enter') AND regexp_matches(" + low + ", 'designation|resident')))"
    )


KEY = "trim(regexp_replace(lower(st), '^\\s*(?:item\\s*)?#?\\s*\\d+(?:\\.\\d+)?[\\.\\):]\\s*', ''), concat(' -:', chr(9)))"
NOISY = (
    "(" + noise("st") + " OR " + KEY + " = '' OR " + KEY + " IN " + listed(titles.PROCEDURAL_TITLES) + " OR " + matches(KEY, titles.PROCEDURAL_PATTERNS) + " OR " + matches("trim(concat(lower(st), ' ', lower(sd)))", titles.CONTACT_PATTERNS) + " OR regexp_matches(lower(st), '^(from:|to:|cc:)') OR NOT regexp_matches(st, '[A-Za-z]') OR (NOT regexp_matches(lower(st), "
    + quoted(summaries.pattern(summaries.CUES)) + ") AND regexp_matches(st, '^[^A-Za-z]*[a-z]')))"
)
# items of three catalogs in four, fewer than three in one of ten, and long ones
SUMMED = "(SELECT catalog_id, item_order, CASE WHEN catalog_id % 6 = 1 THEN concat('Approve $', item_order, ',000 for ', title, repeat(' and more', 40)) ELSE title END AS title, description, CASE WHEN catalog_id % 3 = 0 THEN NULL ELSE result END AS result, page_number FROM " + ITEMS + " i WHERE catalog_id % 4 <> 3 AND (catalog_id % 10 <> 2 OR item_order = 1))"
STATUSES = "(SELECT doc_id + 1 AS catalog_id, CASE WHEN doc_id % 5 = 0 THEN 'empty' WHEN doc_id % 5 = 1 THEN 'complete' END AS segmentation, CASE WHEN doc_id % 9 = 4 THEN 'bad' END AS bad FROM {documents} d)"
MONEY = "list_transform(regexp_extract_all(a, '(?i)\\$\\s?\\d[\\d,]*(?:\\.\\d{2})?(?:\\s*(?:million|billion|thousand|m|k))?', 0), lambda x: trim(x))"


def said(words, yes: str, no: str, more: str = "") -> str:
    return "CASE WHEN " + more + "regexp_matches(lower(a), " + quoted("|".join(words)) + ") THEN " + quoted(yes) + " ELSE " + quoted(no) + " END"


@query(
    "WITH i AS (SELECT catalog_id, item_order, " + T0 + " AS t, " + D0 + " AS d, regexp_replace(coalesce(result, ''), '^\\s+|\\s+$', '', 'g') AS r, coalesce(page_number, 0) AS p FROM " + SUMMED + " s), "
    "x AS (SELECT *, CASE WHEN d = '' THEN COLLAPSE(t) ELSE COLLAPSE(concat(t, ' - ', d)) END AS whole FROM i), y AS (SELECT *, CASE WHEN contains(whole, ' - ') THEN trim(split_part(whole, ' - ', 1)) ELSE whole END AS st, CASE WHEN contains(whole, ' - ') THEN trim(substring(whole, strpos(whole, ' - ') + 3)) ELSE '' END AS sd FROM x), "
    "k AS (SELECT *, sum(length(t) + length(d) + length(r) + length(CAST(p AS VARCHAR)) + " + str(len("Title: \nDescription: \nClassification: \nResult: \nPage: \n\n")) + ") OVER (PARTITION BY catalog_id ORDER BY item_order) AS upto, row_number() OVER (PARTITION BY catalog_id ORDER BY item_order) AS nth FROM y WHERE t <> '' AND NOT " + noise("t") + " AND st <> '' AND NOT (" + NOISY + " AND length(sd) < 24)), "
    "v AS (SELECT *, concat(COLLAPSE(t), CASE WHEN p <> 0 THEN concat(' (p.', p, ')') ELSE '' END, CASE WHEN length(COLLAPSE(d)) >= 24 THEN concat(': ', COLLAPSE(d)) ELSE '' END) AS act FROM k), "
    "g AS (SELECT catalog_id, count(*) FILTER (upto <= 10000) AS n, bool_or(upto > 10000) AS more, trim(string_agg(concat(COLLAPSE(t), ' ', COLLAPSE(d), ' ', COLLAPSE(r)), ' ' ORDER BY item_order) FILTER (upto <= 10000)) AS a, string_agg(concat('- ', act), chr(10) ORDER BY item_order) FILTER (upto <= 10000 AND nth <= 6) AS acts, min(COLLAPSE(t)) FILTER (nth = 1) AS first, bool_or(upto <= 10000 AND COLLAPSE(r) <> '') AS votes FROM v GROUP BY 1), "
    "m AS (SELECT *, list_filter(ms, lambda x, j: list_position(list_transform(ms, lambda y: lower(y)), lower(x)) = j)[:5] AS money FROM (SELECT *, " + MONEY + " AS ms FROM g WHERE n > 0) h), "
    "f AS (SELECT catalog_id, concat('BLUF: Agenda includes ', n, ' substantive item', CASE WHEN n = 1 THEN '' ELSE 's' END, '.', CASE WHEN len(money) > 0 THEN concat(' Mentioned monetary figures include ', array_to_string(money[:2], ', '), '.') ELSE '' END, chr(10), 'Why this matters:', chr(10), '- ', CASE WHEN n = 1 THEN concat(" + quoted(summaries.WHY_ONE[0]) + ", first, " + quoted(summaries.WHY_ONE[1]) + ") ELSE " + quoted(summaries.WHY) + " END, chr(10), 'Top actions:', chr(10), acts, chr(10), "
    "CASE WHEN n = 1 THEN concat('Decision/action requested:', chr(10), acts, chr(10)) ELSE '' END, 'Potential impacts:', chr(10), '- Budget: ', " + said(*summaries.IMPACTS[0][1:], "len(money) > 0 OR ") + ", chr(10), '- Policy: ', " + said(*summaries.IMPACTS[1][1:]) + ", chr(10), '- Process: ', " + said(*summaries.IMPACTS[2][1:]) + ", chr(10), 'Unknowns:', chr(10), "
    "CASE WHEN len(money) > 0 AND votes AND NOT more THEN " + quoted("- " + summaries.UNKNOWN_REST) + " ELSE concat_ws(chr(10), CASE WHEN len(money) = 0 THEN " + quoted("- " + summaries.UNKNOWN_MONEY) + " END, CASE WHEN NOT votes THEN " + quoted("- " + summaries.UNKNOWN_VOTES) + " END, CASE WHEN more THEN concat('- Summary generated from first ', n, ' of ', n + 1, ' agenda items due to context limits.') END) END) AS text FROM m), "
    "z AS (SELECT c.catalog_id, segmentation, bad, text, c.catalog_id IN (SELECT catalog_id FROM i) AS has FROM " + STATUSES + " c LEFT JOIN f ON f.catalog_id = c.catalog_id) "
    "SELECT catalog_id, CASE WHEN bad IS NOT NULL THEN 'error' WHEN NOT has AND segmentation = 'empty' THEN 'complete' WHEN NOT has THEN 'not_generated_yet' WHEN text IS NULL THEN 'blocked_low_signal' ELSE 'complete' END AS status, CASE WHEN bad IS NOT NULL THEN NULL WHEN NOT has AND segmentation = 'empty' THEN " + quoted(summaries.EMPTY_AGENDA) + " WHEN has THEN text END AS summary, bad AS error FROM z"
)
def x16_agenda_summaries(t):
    return summaries.agenda_summaries(from_sql(t, "SELECT * FROM " + STATUSES + " c"), from_sql(t, "SELECT * FROM " + SUMMED + " s"))


FAILURE = "CASE doc_id % 4 WHEN 0 THEN 'timeout' WHEN 1 THEN 'unavailable' WHEN 2 THEN 'empty_response' ELSE 'other' END"
SAYS = "CASE doc_id % 4 WHEN 0 THEN " + quoted(summaries.REASONS["timeout"]) + " WHEN 1 THEN " + quoted(summaries.REASONS["unavailable"]) + " ELSE " + quoted(summaries.REASONS["empty_response"]) + " END"


@query(
    "WITH p AS (SELECT doc_id, category, CASE WHEN doc_id % 31 = 1 THEN '' WHEN doc_id % 31 = 2 THEN '  ' WHEN doc_id % 31 < 6 THEN substring(text, 1, 90) ELSE text END AS text, location, url FROM " + PAGES + " p), e AS (SELECT doc_id, COLLAPSE(text) AS c, " + SAYS + " AS says, CASE WHEN category <> 'minutes' THEN 'Non-agenda fallback only supports minutes documents' WHEN text = '' THEN 'No content to summarize' ELSE " + REASON + " END AS error FROM p) "
    "SELECT doc_id, CASE WHEN error IS NULL THEN concat('BLUF: Minutes document text is available, but the local AI provider ', says, chr(10), '- Source excerpt: ', CASE WHEN c = '' THEN 'No extracted text was available.' WHEN length(c) <= 240 THEN c ELSE concat(rtrim(substring(c, 1, 240)), '...') END, chr(10), " + quoted(summaries.ADVICE[0]) + ", chr(10), " + quoted(summaries.ADVICE[1]) + ", chr(10), " + quoted(summaries.NOTE) + ", says) END AS summary, error FROM e"
)
def x17_minutes_fallback(t):
    d = from_sql(t, "SELECT doc_id, category, CASE WHEN doc_id % 31 = 1 THEN '' WHEN doc_id % 31 = 2 THEN '  ' WHEN doc_id % 31 < 6 THEN substring(text, 1, 90) ELSE text END AS text, location, url, " + FAILURE + " AS failure FROM " + PAGES + " p")
    return d.select("doc_id", summaries.minutes_fallback(F.col("text"), F.col("category"), reason(), F.col("failure")).alias("s")).select("doc_id", "s.*")


#: Two events for each attempt of every order's task, and what may go wrong with them; runs by customer.
TASKS = """(SELECT * FROM (SELECT o_custkey AS run_id, o_orderkey * 10 + k AS seq, CASE WHEN k < 2 OR k = 5 THEN 'task_dispatch' WHEN k = 2 OR k = 6 THEN 'task_start' ELSE 'task_span' END AS event_type, CASE WHEN o_orderkey % 41 = 3 THEN ' ' ELSE concat('t', o_orderkey) END AS task_id, CASE WHEN o_orderkey % 37 = 5 THEN NULL WHEN k < 4 THEN 0 ELSE 1 END AS retry, CASE WHEN k = 0 THEN 'before' WHEN k = 1 THEN 'after' WHEN k = 5 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'after' ELSE 'during' END END AS boundary, CASE WHEN k > 1 AND k <> 5 THEN concat('e', o_orderkey, '-', CASE WHEN k < 4 THEN 0 ELSE 1 END) END AS execution_id, CASE WHEN k = 3 AND o_orderkey % 11 <> 0 THEN 'success' WHEN k = 7 AND o_orderkey % 2 = 0 THEN 'success' WHEN k = 3 OR k = 7 THEN 'failed' END AS outcome, k, o_orderkey FROM {orders} JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k UNION ALL SELECT 2 AS k UNION ALL SELECT 3 AS k UNION ALL SELECT 5 AS k UNION ALL SELECT 6 AS k UNION ALL SELECT 7 AS k) n ON k < 4 OR o_orderkey % 8 = 0) e WHERE NOT (o_orderkey % 19 = k))"""


@query(
    "WITH d AS (SELECT * FROM " + TASKS + " e), w AS (SELECT *, sum(CASE WHEN event_type <> 'task_dispatch' THEN 0 WHEN boundary = 'before' THEN 1 WHEN boundary = 'after' THEN -1 ELSE 0 END) OVER (PARTITION BY run_id, task_id, retry ORDER BY seq) AS open FROM d WHERE trim(task_id) <> ''), "
    "a AS (SELECT run_id, task_id, retry, count(*) FILTER (event_type = 'task_dispatch') AS dis, min(open) >= 0 AND arg_max(open, seq) = 0 AND count(*) FILTER (event_type = 'task_dispatch' AND coalesce(boundary, '') NOT IN ('before', 'after')) = 0 AS fair, count(*) FILTER (event_type = 'task_start') AS st, count(*) FILTER (event_type = 'task_span') AS sp, count(*) FILTER (event_type = 'task_span' AND outcome IS DISTINCT FROM 'success') AS bad FROM w GROUP BY 1, 2, 3), "
    "b AS (SELECT *, fair AND dis > 0 AS done FROM a), l AS (SELECT run_id, task_id, bool_or(done) AS done, max(retry) FILTER (sp > 0) AS late, count(*) FILTER (sp > 0) AS n FROM b GROUP BY 1, 2), x AS (SELECT run_id, execution_id, bool_or(event_type = 'task_start') AS st, bool_or(event_type = 'task_span') AS sp FROM d WHERE execution_id IS NOT NULL GROUP BY 1, 2) "
    "SELECT run_id, 'unknown_task_retry_ordinal' AS reason FROM d WHERE retry IS NULL UNION SELECT run_id, 'unmatched_task_dispatch' FROM b WHERE dis > 0 AND NOT fair UNION SELECT run_id, 'task_start_missing' FROM b WHERE done AND st = 0 UNION SELECT run_id, 'task_terminal_missing' FROM b WHERE done AND sp = 0 UNION SELECT run_id, 'missing_task_dispatch' FROM b WHERE NOT done AND retry = 0 AND st > 0 UNION SELECT run_id, 'missing_retry_dispatch' FROM b WHERE NOT done AND retry > 0 AND st + sp > 0 "
    "UNION SELECT l.run_id, 'task_terminal_failed' FROM l LEFT JOIN b ON b.run_id = l.run_id AND b.task_id = l.task_id AND b.retry = l.late WHERE l.done AND n > 0 AND (late IS NULL OR b.bad > 0) UNION SELECT run_id, 'unfinished_task_attempt' FROM x WHERE st AND NOT sp UNION SELECT run_id, 'orphan_task_terminal' FROM x WHERE sp AND NOT st"
)
def a21_task_evidence(t):
    return evidence.task_reasons(from_sql(t, "SELECT * FROM " + TASKS + " e"))


#: Eligible rows before and after the phases of every customer's run, and spans, with faults.
PHASES = """(SELECT c_custkey AS run_id, CASE WHEN k < 6 THEN 'phase_eligibility' ELSE 'span' END AS event_type, CASE k % 4 WHEN 0 THEN 'extract_parallel' WHEN 1 THEN 'segment_agenda' WHEN 2 THEN 'summarize' ELSE 'pipeline_total' END AS phase, 'catalog' AS subject, CASE WHEN b = 0 THEN 'before' ELSE 'after' END AS boundary, CASE WHEN c_custkey % 7 = 0 THEN 0 WHEN b = 1 AND c_custkey % 3 <> 0 THEN 0 ELSE 2 END AS eligible_count, CASE WHEN c_custkey % 5 = k THEN 'failed' WHEN k > 5 THEN 'success' END AS outcome, CASE WHEN c_custkey % 7 = 0 THEN 0 WHEN b = 1 AND c_custkey % 3 <> 0 THEN 0 WHEN c_custkey % 13 = 1 THEN 1 WHEN c_custkey % 13 = 2 THEN 3 ELSE 2 END AS form FROM {customer} JOIN (SELECT 0 AS k, 0 AS b UNION ALL SELECT 0 AS k, 1 AS b UNION ALL SELECT 1 AS k, 0 AS b UNION ALL SELECT 1 AS k, 1 AS b UNION ALL SELECT 2 AS k, 0 AS b UNION ALL SELECT 2 AS k, 1 AS b UNION ALL SELECT 8 AS k, 0 AS b UNION ALL SELECT 9 AS k, 0 AS b UNION ALL SELECT 10 AS k, 0 AS b UNION ALL SELECT 11 AS k, 0 AS b) n ON c_custkey % 17 <> k + b)"""
FULL = "coalesce(n = 2 AND bef = 1 AND aft = 1, FALSE)"


@query(
    "WITH d AS (SELECT *, form IN (0, 2) AS valid FROM " + PHASES + " p), r AS (SELECT DISTINCT run_id FROM d), e AS (SELECT run_id, phase, count(*) AS n, count(*) FILTER (boundary = 'before') AS bef, count(*) FILTER (boundary = 'after') AS aft, bool_and(valid) AS ok, sum(eligible_count) FILTER (valid AND boundary = 'before') AS work, sum(eligible_count) FILTER (valid AND boundary = 'after') AS rest FROM d WHERE event_type = 'phase_eligibility' GROUP BY 1, 2), "
    "q AS (SELECT r.run_id, x.phase, e.* EXCLUDE (run_id, phase) FROM r CROSS JOIN (SELECT unnest(['extract_parallel', 'segment_agenda', 'summarize']) AS phase) x LEFT JOIN e ON e.run_id = r.run_id AND e.phase = x.phase), s AS (SELECT run_id, phase, count(*) AS n, bool_and(outcome IS NOT DISTINCT FROM 'success') AS ok FROM d WHERE event_type = 'span' GROUP BY 1, 2), "
    "u AS (SELECT r.run_id, x.phase, n, ok FROM r CROSS JOIN (SELECT unnest(['extract_parallel', 'segment_agenda', 'summarize', 'pipeline_total']) AS phase) x LEFT JOIN s ON s.run_id = r.run_id AND s.phase = x.phase) "
    "SELECT run_id, 'reason' AS kind, concat('phase_eligibility_incomplete:', phase, ':catalog') AS reason FROM q WHERE NOT " + FULL + " UNION ALL SELECT run_id, 'reason', concat('phase_eligibility_invalid:', phase, ':catalog') FROM q WHERE " + FULL + " AND NOT ok UNION ALL SELECT run_id, CASE phase WHEN 'extract_parallel' THEN 'warning' ELSE 'reason' END, CASE phase WHEN 'extract_parallel' THEN 'extraction_remainder_nonzero' ELSE concat('phase_remainder_nonzero:', phase, ':catalog') END FROM q WHERE " + FULL + " AND coalesce(rest, 0) > 0 "
    "UNION ALL SELECT run_id, 'reason', 'initial_workload_missing' FROM q GROUP BY 1 HAVING coalesce(sum(work) FILTER (" + FULL + "), 0) = 0 UNION ALL SELECT run_id, 'reason', concat(CASE WHEN n = 1 THEN 'phase_span_failed:' ELSE 'phase_span_incomplete:' END, phase) FROM u WHERE n IS DISTINCT FROM 1 OR NOT ok"
)
def a21_phase_evidence(t):
    d = from_sql(t, "SELECT * FROM " + PHASES + " p").withColumn("ids", F.expr("CASE form WHEN 0 THEN CAST(array() AS ARRAY<BIGINT>) WHEN 1 THEN array(2L, 1L) WHEN 2 THEN array(1L, 2L) ELSE array(0L, 2L) END"))
    return evidence.phase_reasons(d, d.select("run_id"))


#: Every line of every document, some as the rules on lines know them.
MARKED = """(SELECT id, CASE item_order % 12 WHEN 0 THEN concat('A. ', title) WHEN 1 THEN '20.154.33 (dial)' WHEN 2 THEN 'Comm unication Access Information' WHEN 3 THEN concat('16 in the appropriate ', title) WHEN 4 THEN 'approve the minutes' WHEN 5 THEN '42 - 17' WHEN 6 THEN 'Maria P. Lopez' WHEN 7 THEN 'You may enter as a resident' WHEN 8 THEN NULL ELSE title END AS title FROM {agenda_item} a)"""
LINE = "coalesce(title, '')"
COLLAPSED = "COLLAPSE(coalesce(title, ''))"


@query(
    "SELECT id, regexp_matches(lower(trim(" + LINE + ")), " + quoted("|".join(summaries.LINKS) + "|" + summaries.pattern(summaries.ATTENDANCE)) + ") AS attendance, " + noise(LINE) + " AS segment_noise, NOT regexp_matches(" + COLLAPSED + ", '[A-Za-z]') OR (NOT regexp_matches(lower(" + COLLAPSED + "), " + quoted(summaries.pattern(summaries.CUES)) + ") AND regexp_matches(" + COLLAPSED + ", '^[^A-Za-z]*[a-z]')) AS fragment, regexp_matches("
    + COLLAPSED + ", " + quoted(scores.SUB_MARKER) + ") AS sub_marker, regexp_matches(" + COLLAPSED + ", " + quoted(scores.NAME_PATTERN) + ") AND NOT list_has_any(list_transform(string_split(lower(" + COLLAPSED + "), ' '), lambda x: trim(x, '.')), [" + ", ".join(map(quoted, scores.NOT_NAMES)) + "]) AS name_only FROM " + MARKED + " m"
)
def f13_line_noise(t):
    d, line = from_sql(t, "SELECT * FROM " + MARKED + " m"), F.coalesce("title", F.lit(""))
    return d.select("id", summaries.is_attendance(line).alias("attendance"), summaries.is_segment_noise(line).alias("segment_noise"), summaries.is_line_fragment(line).alias("fragment"), collapse(line).rlike(scores.SUB_MARKER).alias("sub_marker"), scores.is_name_only(line).alias("name_only"))
