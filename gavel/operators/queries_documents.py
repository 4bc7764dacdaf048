"""Queries of title rules, bad content, summaries, decoding, files and streams with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from gavel.operators import records, titles, topics
from gavel.operators.queries_people import TFIDF
from gavel.plans import tables
from gavel.plans.bridge import Tables, from_sql, twin
from gavel.sources import text_scans
from gavel.streaming import jobs

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = twin(sql)
        return f

    return add


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def matches(c: str, patterns, how: str = " OR ") -> str:
    return "(" + how.join(f"regexp_matches({c}, {quoted(p)})" for p in patterns) + ")"


def listed(values) -> str:
    return "(" + ", ".join(map(quoted, values)) + ")"


#: Every line of every document as a title, some in words that the rules know.
TITLES = """(SELECT id, catalog_id, item_order, page_number, CASE item_order % 13 WHEN 0 THEN '1. Call to Order' WHEN 1 THEN concat('Subject: ', title) WHEN 2 THEN 'Public  Comment Period' WHEN 3 THEN concat(title, ' Phone: 555-123-4567') WHEN 4 THEN 'From: the Clerk' WHEN 5 THEN 'Item #4) Land Acknowledgement -' WHEN 6 THEN 'Consent Calendar' WHEN 7 THEN concat('Join the webinar ', title) WHEN 8 THEN 'Adopted:' ELSE title END AS title FROM {agenda_item} a)"""
LOW = "lower(COLLAPSE(coalesce(title, '')))"
KEY = "trim(regexp_replace(" + LOW + ", '^\\s*(?:item\\s*)?#?\\s*\\d+(?:\\.\\d+)?[\\.\\):]\\s*', ''), concat(' -:', chr(9)))"
PROCEDURE = "(" + KEY + " = '' OR " + KEY + " IN " + listed(titles.PROCEDURAL_TITLES) + " OR " + matches(KEY, titles.PROCEDURAL_PATTERNS) + ")"
CONTACT = "(" + matches(LOW, titles.CONTACT_PATTERNS) + " OR regexp_matches(" + LOW + ", '^(from:|to:|cc:)'))"
BOILER = "(" + LOW + " = '' OR regexp_matches(" + LOW + ", 'https?://|www\\.') OR " + matches(LOW, titles.BOILERPLATE_PATTERNS) + " OR (ends_with(" + LOW + ", ':') AND length(" + LOW + ") <= 60))"


@query("SELECT id, " + PROCEDURE + " AS procedural, " + CONTACT + " AS contact, " + BOILER + " AS boilerplate FROM " + TITLES + " t")
def f13_title_noise(t):
    d, title = from_sql(t, "SELECT * FROM " + TITLES + " t"), F.col("title")
    return d.select("id", titles.is_procedural(title).alias("procedural"), titles.is_contact(title).alias("contact"), titles.is_boilerplate(title).alias("boilerplate"))


@query(
    "SELECT catalog_id, count(*) AS items, count(*) FILTER (NOT " + PROCEDURE + " AND NOT " + CONTACT + ") AS substantive, count(*) >= 3 AND count(*) FILTER (NOT " + PROCEDURE + " AND NOT " + CONTACT + ") >= 3 AS accepted FROM " + TITLES + " t WHERE " + LOW + " <> '' AND (starts_with(" + LOW + ", 'subject:') OR NOT ("
    + matches(LOW, titles.PORTAL_PROCEDURE) + " OR " + LOW + " IN " + listed(titles.PORTAL_SECTIONS) + " OR " + matches(LOW, titles.PORTAL_NOTICES) + " OR (length(" + LOW + ") >= 180 AND NOT (contains(" + LOW + ", 'public hearing') OR contains(" + LOW + ", 'subject:') OR contains(" + LOW + ", 'application no'))))) GROUP BY 1"
)
def f15_portal_acceptance(t):
    return titles.portal_acceptance(from_sql(t, "SELECT * FROM " + TITLES + " t"), "catalog_id")


#: Every document, some behind a portal's error texts or a report's head.
PAGES = """(SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'agenda' ELSE 'minutes' END AS category, CASE WHEN doc_id % 2 = 0 THEN 'a/b.HTML' ELSE 'a/b.pdf' END AS location, CASE WHEN doc_id % 5 = 0 THEN 'https://example.org/' ELSE 'https://portal.laserfiche.com/Portal/DocView.aspx?id=1' END AS url, concat(CASE WHEN doc_id % 11 < 3 THEN concat('The system has encountered an error and could not complete your request.', chr(10), 'If the problem persists,', chr(10), 'please contact the site administrator') WHEN doc_id % 11 < 5 THEN 'Loading... The URL can be used to link to this page. Your browser does not support the video tag' WHEN doc_id % 11 < 8 THEN concat('Agenda Report', chr(10), 'TO: Council', chr(10), 'From : Staff', chr(10), 'Subject: x', chr(10), CASE WHEN doc_id % 4 = 0 THEN concat('Public Comment', chr(10)) ELSE '' END, 'Recommendation', chr(10), CASE WHEN doc_id % 7 = 0 THEN '' ELSE 'Agenda Number: 4' END) ELSE '' END, chr(10), coalesce(text, '')) AS text FROM {documents} d)"""
STRONG = " + ".join(f"CAST(regexp_matches(text, {quoted(p)}) AS INTEGER)" for p in titles.REPORT_STRONG)
SUPPORT = " + ".join(f"CAST(contains(lower(text), {quoted(p)}) AS INTEGER)" for p in titles.REPORT_SUPPORT)
REPORT = "((contains(lower(text), 'agenda report') OR contains(lower(text), 'administrative report')) AND " + STRONG + " >= 4 AND " + " + ".join(f"len(regexp_extract_all(text, {quoted(p)}))" for p in titles.AGENDA_LINES) + " = 0 AND NOT (len(regexp_extract_all(text, " + quoted(titles.AGENDA_HEADING) + ")) >= 20 AND " + SUPPORT + " < 2 AND NOT (contains(lower(text), '{{ section') OR contains(lower(text), '{{ item.tracking'))) AND (" + SUPPORT + " >= 1 OR contains(lower(text), 'administrative report')))"
REASON = "coalesce(CASE WHEN regexp_matches(lower(location), '\\.html?$') AND contains(lower(url), 'portal.laserfiche.com/portal/') AND regexp_matches(lower(url), 'docview\\.aspx|electronicfile\\.aspx') THEN CASE WHEN " + matches("text", titles.ERROR_PAGE, " AND ") + " THEN 'laserfiche_error_page_detected' WHEN " + matches("text", titles.LOADING_SHELL, " AND ") + " THEN 'laserfiche_loading_shell_detected' END END, CASE WHEN category = 'agenda' AND " + REPORT + " THEN 'single_item_staff_report_detected' END)"


def pages(t):
    return from_sql(t, "SELECT * FROM " + PAGES + " p")


def reason():
    return titles.bad_content(F.col("text"), F.col("location"), F.col("url"), F.col("category"))


@query("SELECT doc_id, " + REASON + " AS reason FROM " + PAGES + " p")
def f11_bad_content(t):
    return pages(t).select("doc_id", reason().alias("reason"))


@query("SELECT doc_id + 1 AS catalog_id, CASE WHEN reason IS NOT NULL THEN NULL ELSE summary END AS summary, CASE WHEN reason IS NULL THEN items END AS items, reason FROM (SELECT doc_id, substring(text, 1, 40) AS summary, " + REASON + " AS reason FROM " + PAGES + " p) r LEFT JOIN (SELECT catalog_id, count(*) AS items FROM {agenda_item} GROUP BY 1) i ON i.catalog_id = doc_id + 1")
def u12_reset_bad_content(t):
    d = pages(t).select((F.col("doc_id") + 1).alias("catalog_id"), F.substring("text", 1, 40).alias("summary"), reason().alias("reason"))
    items = t.agenda_item.join(d.filter("reason IS NOT NULL"), "catalog_id", "left_anti").groupBy("catalog_id").agg(F.count("*").alias("items"))
    return d.join(items, "catalog_id", "left").select("catalog_id", F.when(F.col("reason").isNull(), F.col("summary")).alias("summary"), "items", "reason")


NEW_ITEMS = "(SELECT catalog_id, item_order, CASE WHEN item_order % 6 = 0 THEN '   ' ELSE concat('  New ', title, '  ') END AS title FROM {agenda_item} n)"
PROCESSED = "(SELECT doc_id + 1 AS catalog_id, " + REASON + " AS reason FROM " + PAGES + " p WHERE category = 'agenda')"


@query("SELECT p.catalog_id, CASE WHEN reason IS NOT NULL THEN 'failed' WHEN n > 0 THEN 'complete' ELSE 'empty' END AS status, CASE WHEN reason IS NULL THEN coalesce(n, 0) END AS items, reason AS error FROM " + PROCESSED + " p LEFT JOIN (SELECT catalog_id, count(*) AS n FROM " + NEW_ITEMS + " x WHERE COLLAPSE(title) <> '' GROUP BY 1) n ON n.catalog_id = p.catalog_id")
def u17_segmentation_status(t):
    processed = pages(t).filter("category = 'agenda'").select((F.col("doc_id") + 1).alias("catalog_id"), reason().alias("reason"))
    return titles.replaced_items(t.agenda_item, from_sql(t, "SELECT * FROM " + NEW_ITEMS + " n"), processed)[1]


@query("WITH good AS (SELECT catalog_id FROM " + PROCESSED + " p WHERE reason IS NULL) SELECT catalog_id, item_order, title FROM {agenda_item} i WHERE catalog_id NOT IN (SELECT catalog_id FROM good) UNION ALL SELECT catalog_id, item_order, substring(COLLAPSE(title), 1, 1000) FROM " + NEW_ITEMS + " n WHERE catalog_id IN (SELECT catalog_id FROM good) AND COLLAPSE(title) <> ''")
def u17_replaced_items(t):
    processed = pages(t).filter("category = 'agenda'").select((F.col("doc_id") + 1).alias("catalog_id"), reason().alias("reason"))
    return titles.replaced_items(t.agenda_item, from_sql(t, "SELECT * FROM " + NEW_ITEMS + " n"), processed)[0]


#: A summary for every document: its first lines under headings, and words that it may lack.
SUMMARIES = """(SELECT doc_id, coalesce(text, '') AS source, concat(CASE WHEN doc_id % 4 = 0 THEN concat('BLUF: ', substring(coalesce(text, ''), 1, 60), chr(10)) ELSE '' END, CASE WHEN doc_id % 9 = 8 THEN '' ELSE concat('Why this matters:', chr(10), '- ', substring(coalesce(text, ''), 1, 90), chr(10), 'Top actions:', chr(10), CASE WHEN doc_id % 5 = 0 THEN concat('* Wholly different zebra xylophone quartz', chr(10)) ELSE '' END, 'Potential impacts:', chr(10), 'Included 3 of ', doc_id % 10, ' items', chr(10), CASE WHEN doc_id % 3 = 0 THEN 'Unknowns:' ELSE 'Agenda summary unavailable' END) END) AS summary FROM {documents} d)"""
SUMMARY = "lower(summary)"
CLAIM_LINES = "(SELECT doc_id, k AS claim_no, line, trim(regexp_replace(trim(regexp_replace(line, '^[*•-]+\\s*', '')), '^[^A-Za-z0-9]+', '')) AS claim FROM (SELECT doc_id, generate_subscripts(l, 1) - 1 AS k, COLLAPSE(unnest(l)) AS line FROM (SELECT doc_id, string_split(summary, chr(10)) AS l FROM " + SUMMARIES + " s) a) b)"
NO_CLAIM = "(length(claim) < 5 OR starts_with(lower(claim), 'bluf:') OR lower(claim) IN " + listed(titles.HEADERS) + " OR (ends_with(lower(claim), ':') AND len(regexp_extract_all(lower(claim), '[a-z0-9'']+')) <= 6) OR (starts_with(lower(claim), 'here') AND contains(lower(claim), 'summary')) OR contains(lower(claim), 'executive summary') OR (contains(lower(claim), 'summary') AND ends_with(lower(claim), ':')) OR starts_with(lower(claim), 'summary of the meeting'))"


@query("SELECT doc_id, " + " AND ".join(f"contains({SUMMARY}, {quoted(s)})" for s in titles.SECTIONS) + " AS sections, " + " OR ".join(f"contains({SUMMARY}, {quoted(s)})" for s in titles.FALLBACKS) + " AS fallback, " + matches(SUMMARY, titles.PARTIAL) + " AS partial FROM " + SUMMARIES + " s")
def x18_compliance(t):
    return from_sql(t, "SELECT * FROM " + SUMMARIES + " s").select("doc_id", titles.compliance(F.col("summary")).alias("c")).select("doc_id", "c.*")


@query(
    "WITH s AS (SELECT * FROM " + SUMMARIES + " s), l AS (SELECT * FROM " + CLAIM_LINES + " c), plain AS (SELECT doc_id, claim_no, claim FROM l WHERE NOT " + NO_CLAIM + "), bluf AS (SELECT doc_id, min(claim_no) AS claim_no, min_by(trim(substring(line, 6)), claim_no) AS claim FROM l WHERE starts_with(lower(line), 'bluf:') GROUP BY 1), "
    "c AS (SELECT * FROM plain UNION ALL SELECT * FROM bluf WHERE length(claim) >= 5 AND doc_id NOT IN (SELECT doc_id FROM plain)), tok AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(source), '[a-z0-9'']+')) AS token FROM s), pre AS (SELECT DISTINCT doc_id, substring(token, 1, 5) AS prefix FROM tok WHERE length(token) >= 5), "
    "w AS (SELECT doc_id, claim_no, token FROM (SELECT doc_id, claim_no, unnest(regexp_extract_all(lower(claim), '[a-z0-9'']+')) AS token FROM c) x WHERE length(token) >= 3 AND token NOT IN " + listed(titles.CLAIM_STOP_WORDS) + "), "
    "m AS (SELECT w.doc_id, w.claim_no, avg(CAST(tok.token IS NOT NULL OR pre.prefix IS NOT NULL AS INTEGER)) AS share FROM w LEFT JOIN tok ON tok.doc_id = w.doc_id AND tok.token = w.token LEFT JOIN pre ON pre.doc_id = w.doc_id AND length(w.token) >= 5 AND pre.prefix = substring(w.token, 1, 5) GROUP BY 1, 2), "
    "has AS (SELECT DISTINCT doc_id FROM tok), e AS (SELECT c.doc_id, CASE WHEN has.doc_id IS NULL THEN 0.0 ELSE coalesce(share, 1.0) END AS share, has.doc_id IS NULL AS none FROM c LEFT JOIN m USING (doc_id, claim_no) LEFT JOIN has ON has.doc_id = c.doc_id), "
    "g AS (SELECT doc_id, count(*) AS claims, count(*) FILTER (share < 0.45 OR none) AS unsupported, round(avg(share), 6) AS coverage FROM e GROUP BY 1) SELECT s.doc_id, coalesce(claims, 0) AS claims, coalesce(unsupported, 1) AS unsupported, coalesce(coverage, 0.0) AS coverage, coalesce(unsupported = 0, false) AS grounded FROM s LEFT JOIN g USING (doc_id)"
)
def x5_grounding(t):
    return titles.grounding(from_sql(t, "SELECT * FROM " + SUMMARIES + " s"), "doc_id", "summary", "source")


ANSWERS = """(SELECT o_orderkey AS id, concat('Sure:', chr(10), 'ITEM 1: ', o_orderpriority, '  hearing (page ', o_orderkey % 40, ') - on ', o_orderstatus, chr(10), ' item ', CASE WHEN o_orderkey % 3 = 0 THEN '1' ELSE '2' END, ' : ', CASE WHEN o_orderkey % 3 = 0 THEN concat(lower(o_orderpriority), ' HEARING (Page 9)') ELSE concat('Report', chr(10), 'first', chr(10), 'second') END, chr(10), 'Item 3:', CASE WHEN o_orderkey % 2 = 0 THEN concat(' Budget – details of ', o_custkey) ELSE '' END, chr(10)) AS answer FROM {orders} o)"""


@query(
    "WITH h AS (SELECT id, regexp_extract_all(answer, " + quoted(titles.ITEM_HEADER) + ", 1) AS n, regexp_split_to_array(answer, " + quoted(titles.ITEM_HEADER.replace("(\\d+)", "\\d+")) + ") AS b FROM " + ANSWERS + " a), i AS (SELECT id, generate_subscripts(n, 1) AS k, CAST(unnest(n) AS BIGINT) AS item_order, regexp_replace(unnest(b[2:]), '^\\s+|\\s+$', '', 'g') AS body FROM h), "
    "p AS (SELECT id, k, item_order, body, regexp_matches(body, " + quoted(titles.ITEM_PAGE) + ") AS paged, regexp_matches(body, " + quoted(titles.ITEM_DASH) + ") AS dashed FROM i WHERE body <> ''), "
    "q AS (SELECT id, k, item_order, COLLAPSE(CASE WHEN paged THEN regexp_extract(body, " + quoted(titles.ITEM_PAGE) + ", 1) WHEN dashed THEN regexp_extract(body, " + quoted(titles.ITEM_DASH) + ", 1) ELSE split_part(body, chr(10), 1) END) AS title, CASE WHEN paged THEN CAST(regexp_extract(body, " + quoted(titles.ITEM_PAGE) + ", 2) AS BIGINT) ELSE 1 END AS page_number, "
    "CASE WHEN paged THEN regexp_extract(body, " + quoted(titles.ITEM_PAGE) + ", 3) WHEN dashed THEN regexp_extract(body, " + quoted(titles.ITEM_DASH) + ", 2) ELSE regexp_replace(body, '^[^\\n]*\\n?', '') END AS rest FROM p) "
    "SELECT id, item_order, title, page_number, COLLAPSE(regexp_replace(regexp_replace(rest, '^\\s+', ''), '^[-–—:]\\s*', '')) AS description FROM (SELECT *, row_number() OVER (PARTITION BY id, item_order, lower(title) ORDER BY k) AS r FROM q WHERE title <> '') z WHERE r = 1"
)
def x23_model_items(t):
    return titles.model_items(from_sql(t, "SELECT * FROM " + ANSWERS + " a"), "id", "answer")


@query(
    "WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z][a-z''-]{2,}'), lambda x: x NOT IN " + listed(topics.STOP_WORDS) + ") AS w FROM {documents}), g AS (SELECT doc_id, 1 AS k, unnest(w) AS phrase FROM w UNION ALL SELECT doc_id, 0, unnest(list_transform(range(1, len(w)), lambda i: concat(w[i], ' ', w[i + 1]))) FROM w UNION ALL SELECT doc_id, 0, unnest(list_transform(range(1, len(w) - 1), lambda i: concat(w[i], ' ', w[i + 1], ' ', w[i + 2]))) FROM w) "
    "SELECT doc_id, phrase, rank FROM (SELECT doc_id, phrase, row_number() OVER (PARTITION BY doc_id ORDER BY k, count(*) DESC, phrase) AS rank FROM g GROUP BY doc_id, k, phrase) r WHERE rank <= 5"
)
def x9_small_corpus_keywords(t):
    return titles.small_corpus_keywords(t.documents, topics.STOP_WORDS)


@query(TFIDF + "SELECT doc_id, string_agg(term, '|' ORDER BY rank) AS keywords FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term) AS rank FROM s) r WHERE rank <= 5 GROUP BY doc_id")
def w6_top_keywords(t):
    return topics.keywords(t.documents, most=5).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x.term), "|").alias("keywords"))


# files: written from the tables to the shared folder, read back by the scans


def folder(t: Tables) -> str:
    return tables.new_folder(t._spark, "files")


CITIES = "(SELECT n_name AS city, concat(CASE WHEN n_nationkey % 4 = 3 THEN 'ocd-division/county:' ELSE 'ocd-division/place:' END, lower(n_name)) AS ocd_division_id FROM {nation} n)"


@query("SELECT city, split_part(ocd_division_id, '/place:', 2) AS slug FROM " + CITIES + " c WHERE contains(ocd_division_id, '/place:')")
def s1_city_table(t):
    path = folder(t)
    from_sql(t, "SELECT * FROM " + CITIES + " c").write.csv(path, header=True)
    return text_scans.city_table(t._spark, path).select("city", "slug")


REGISTRY = """(SELECT CASE WHEN s_suppkey % 9 = 0 THEN '' WHEN s_suppkey % 9 = 1 THEN 'Bad Slug' WHEN s_suppkey % 9 = 2 THEN 'twice' ELSE concat('nation_', s_nationkey, CASE WHEN s_suppkey % 9 = 3 THEN '' ELSE concat('_', s_suppkey) END) END AS city_slug, CASE WHEN s_suppkey % 7 = 0 THEN 'wave9' ELSE 'wave1' END AS wave, CASE WHEN s_suppkey % 11 = 0 THEN 'maybe' ELSE ' yes ' END AS enabled, CASE WHEN s_suppkey % 13 = 0 THEN 'good' ELSE 'pass' END AS quality_gate, CASE WHEN s_suppkey % 5 = 0 THEN 'yes' ELSE 'no' END AS stable_noop_eligible, CASE WHEN s_suppkey % 10 = 0 THEN '' ELSE 'run' END AS last_fresh_pass_run_id, CASE WHEN s_suppkey % 3 = 0 THEN 'legistar_office_records' ELSE '' END AS roster_source, CASE WHEN s_suppkey % 6 = 0 THEN 'Council' ELSE '' END AS roster_body_name, CASE WHEN s_suppkey % 12 = 0 THEN '2024-02-31' WHEN s_suppkey % 6 = 0 THEN '2024-02-03' ELSE '' END AS roster_source_verified_at FROM {supplier} s)"""


@query(
    "WITH r AS (SELECT *, trim(enabled) AS e, count(*) OVER (PARTITION BY city_slug) AS n, CAST(roster_source <> '' AS INTEGER) + CAST(roster_body_name <> '' AS INTEGER) + CAST(roster_source_verified_at <> '' AS INTEGER) AS f FROM " + REGISTRY + " g), v AS ("
    "SELECT city_slug, 'missing_slug' AS reason FROM r WHERE city_slug = '' UNION ALL SELECT city_slug, 'invalid_slug' FROM r WHERE city_slug <> '' AND NOT regexp_matches(city_slug, '^[a-z0-9_]+$') UNION ALL SELECT city_slug, 'duplicate_slug' FROM r WHERE city_slug <> '' AND n > 1 UNION ALL SELECT city_slug, 'invalid_wave' FROM r WHERE wave NOT IN ('', 'wave1', 'wave2') UNION ALL SELECT city_slug, 'invalid_enabled' FROM r WHERE e NOT IN ('yes', 'no') "
    "UNION ALL SELECT city_slug, 'invalid_quality_gate' FROM r WHERE quality_gate NOT IN ('pass', 'fail', 'pending', 'insufficient_data') UNION ALL SELECT city_slug, 'missing_noop_run' FROM r WHERE stable_noop_eligible = 'yes' AND last_fresh_pass_run_id = '' UNION ALL SELECT city_slug, 'incomplete_roster' FROM r WHERE f NOT IN (0, 3) UNION ALL SELECT city_slug, 'invalid_verified_at' FROM r WHERE f = 3 AND try_cast(roster_source_verified_at AS DATE) IS NULL "
    "UNION ALL SELECT city_slug, 'unknown_city' FROM r WHERE city_slug <> '' AND city_slug NOT IN (SELECT lower(n_name) FROM {nation})) SELECT city_slug, reason, count(*) AS n FROM v GROUP BY 1, 2"
)
def s2_registry_violations(t):
    path = folder(t)
    from_sql(t, "SELECT * FROM " + REGISTRY + " g").write.csv(path, header=True)
    cities = t.nation.select(F.lower("n_name").alias("slug"))
    return text_scans.registry_violations(text_scans.registry(t._spark, path), cities).groupBy("city_slug", "reason").agg(F.count("*").alias("n"))


@query("SELECT event_id, event_type AS phase, user_id AS catalog_id FROM {events} WHERE event_id % 50 <> 7")
def s3_run_log(t):
    path = folder(t)
    whole = F.to_json(F.struct("event_id", F.col("event_type").alias("phase"), F.col("user_id").alias("catalog_id")))
    t.events.select(F.when(F.col("event_id") % 50 == 7, F.substring(whole, 1, 12)).otherwise(whole).alias("value")).write.text(path)
    return text_scans.json_lines(t._spark, path, T.StructType.fromDDL("event_id long, phase string, catalog_id long"), "DROPMALFORMED")


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS run_id, count(*) AS requests, count(*) FILTER (value > 50) AS timeouts, row_number() OVER (ORDER BY CAST(ts AS DATE)) AS day_no FROM {events} GROUP BY CAST(ts AS DATE)")
def s7_day_summaries(t):
    path = folder(t)
    day = F.to_date("ts")
    days = t.events.groupBy(day.cast("string").alias("run_id"), F.unix_timestamp(day.cast("timestamp")).alias("timestamp_epoch_s")).agg(F.count("*").alias("requests"), F.count_if(F.col("value") > 50).alias("timeouts"))
    days.withColumn("run", F.col("run_id")).write.partitionBy("run").json(path)
    return text_scans.day_summaries(t._spark, path, "run_id string, timestamp_epoch_s long, requests long, timeouts long").select("run_id", "requests", "timeouts", "day_no")


@query("SELECT p_brand AS topic, count(*) AS n, 'all' AS city, '1996-01-01' AS date_from, '1998-06-30' AS date_to FROM {part} GROUP BY 1")
def s11_trends_export(t):
    path = folder(t)
    counts = t.part.groupBy(F.col("p_brand").alias("topic")).agg(F.count("*").alias("count"))
    text_scans.export_trends(counts, path, "all", "1996-01-01", "1998-06-30")
    return t._spark.read.csv(path, header=True, schema="topic string, count long, city string, date_from string, date_to string").withColumnRenamed("count", "n")


@query("SELECT event_type AS kind, phase, count(*) AS n FROM (SELECT 'task_start' AS event_type, event_type AS phase FROM {events} UNION ALL SELECT 'task_span', event_type FROM {events}) e GROUP BY 1, 2")
def s12_event_log(t):
    path = folder(t)
    rows = t.events.select("event_id", F.col("event_type").alias("phase"), F.col("value").alias("duration_s"))
    text_scans.append_events(rows, path, "task_start")
    text_scans.append_events(rows, path, "task_span")
    log = text_scans.json_lines(t._spark, path, T.StructType.fromDDL("event_type string, event_id long, phase string, duration_s double"))
    return log.groupBy(F.col("event_type").alias("kind"), "phase").agg(F.count("*").alias("n"))


@query(
    "SELECT s.id, s.ocd_division_id, CAST(s.record_date AS VARCHAR) AS record_date, s.name, p.id AS place_id FROM {event_stage} s JOIN {place} p ON p.ocd_division_id = s.ocd_division_id WHERE NOT EXISTS (SELECT 1 FROM {event} e WHERE e.place_id = p.id AND e.record_date IS NOT DISTINCT FROM s.record_date AND e.name = s.name) "
    "QUALIFY row_number() OVER (PARTITION BY p.id, s.record_date, s.name ORDER BY s.id) = 1"
)
def m1_promoted_stream(t):
    path = folder(t)
    t.event_stage.write.parquet(f"{path}/stage")
    stream = jobs.parquet_stream(t._spark, f"{path}/stage", t.event_stage.schema)
    jobs.promote_stream(stream, lambda: t.event, t.place, lambda rows, number: rows.write.mode("overwrite").parquet(f"{path}/promoted/batch={number}"), f"{path}/checkpoint").awaitTermination()
    return t._spark.read.parquet(f"{path}/promoted").select("id", "ocd_division_id", F.col("record_date").cast("string").alias("record_date"), "name", "place_id")
