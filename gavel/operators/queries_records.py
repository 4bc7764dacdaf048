"""Queries of catalog state, coverage, mutations, text columns and run reports with their DuckDB twins."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from gavel.functions import text as X
from gavel.operators.agenda_text import context_windows
from gavel.operators import records, runs
from gavel.operators.queries_search import KIND, NOISE
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


FIRST = "(SELECT catalog_id, min(id) AS document_id, min_by(category, id) AS category FROM {document} GROUP BY 1)"


@query("SELECT catalog_id, document_id, " + KIND.format("category") + " AS kind FROM " + FIRST + " f")
def j6_first_document_kind(t):
    return records.first_document_kind(t.document)


ITEMS = "(SELECT catalog_id, count(*) AS items, SHA(string_agg(concat(CAST(item_order AS VARCHAR), chr(31), COLLAPSE(title), chr(31), CAST(page_number AS VARCHAR)), chr(30) ORDER BY item_order)) AS agenda_items_hash FROM {agenda_item} GROUP BY 1)"


@query("SELECT catalog_id, items, agenda_items_hash FROM " + ITEMS + " i")
def x3_item_hashes(t):
    return records.item_hashes(t.agenda_item)


STATE = "CASE WHEN coalesce(summary, '') = '' THEN 'none' WHEN coalesce({0}, '') <> '' AND summary_source_hash = {0} THEN 'fresh' ELSE 'stale' END"
HITS = " + ".join(f"CAST(contains(low, '{x}') AS INTEGER)" for x in X.BOILERPLATE)
QUALITY = (
    "(SELECT id, length(regexp_replace(raw, '^\\s+|\\s+$', '', 'g')) AS char_count, len(tok) AS token_count, len(list_distinct(tok)) AS distinct_token_count, "
    "round(length(regexp_replace(raw, '[^\\p{{L}}]+', '', 'g')) / greatest(length(raw), 1), 6) AS alpha_ratio, len(lines) AS line_count, "
    "CASE WHEN len(lines) > 0 THEN round(len(list_distinct(lines)) / len(lines), 6) ELSE 0 END AS unique_line_ratio, "
    "CASE WHEN len(lines) > 0 THEN round(coalesce(b, 0) / len(lines), 6) ELSE 0 END AS boilerplate_line_ratio FROM ("
    "SELECT id, coalesce(content, '') AS raw, regexp_extract_all(lower(coalesce(content, '')), '[a-z0-9'']+') AS tok, "
    "list_filter(list_transform(regexp_split_to_array(coalesce(content, ''), '\\r\\n|[\\n\\r\\x0B\\f]'), lambda x: regexp_replace(x, '^[ \\t\\x0B\\f]+|[ \\t\\x0B\\f]+$', '', 'g')), lambda x: x <> '') AS lines FROM {catalog}) a LEFT JOIN ("
    "SELECT id AS bid, count(*) AS b FROM (SELECT id, low, " + HITS + " AS hits, len(regexp_extract_all(low, '[a-z0-9'']+')) AS words FROM (SELECT id, lower(unnest(regexp_split_to_array(content, '\\r\\n|[\\n\\r\\x0B\\f]'))) AS low FROM {catalog}) l) h "
    "WHERE regexp_matches(low, '[^ \\t\\x0B\\f]') AND (contains(low, 'http://') OR contains(low, 'https://') OR contains(low, 'www.') OR (contains(low, '@') AND contains(low, '.')) OR (hits > 0 AND (hits >= 2 OR words <= 12))) GROUP BY 1) b ON bid = id)"
).replace("{{", "{").replace("}}", "}")


@query("SELECT id, char_count, token_count, distinct_token_count, alpha_ratio, line_count, unique_line_ratio, boilerplate_line_ratio FROM " + QUALITY + " q")
def x6_source_quality(t):
    return t.catalog.select("id", X.source_quality(F.col("content")).alias("q")).select("id", "q.*")


@query("SELECT id, char_count >= 80 AND distinct_token_count >= 8 AND alpha_ratio >= 0.35 AND boilerplate_line_ratio <= 0.85 AS summarizable, char_count >= 100 AND distinct_token_count >= 10 AND alpha_ratio >= 0.35 AND boilerplate_line_ratio <= 0.85 AS topicable FROM " + QUALITY + " q")
def f10_low_signal_gates(t):
    d = t.catalog.select("id", X.source_quality(F.col("content")).alias("q"))
    return d.select("id", X.is_summarizable(F.col("q")).alias("summarizable"), X.is_topicable(F.col("q")).alias("topicable"))


STATUS = "(SELECT c.id AS catalog_id, coalesce(" + KIND.format("category") + ", 'unknown') AS kind, coalesce(items, 0) AS items, summary, summary_source_hash, content_hash, CASE WHEN " + KIND.format("category") + " = 'agenda' THEN CASE WHEN agenda_segmentation_status = 'empty' AND coalesce(agenda_items_hash, '') = '' THEN content_hash ELSE agenda_items_hash END ELSE content_hash END AS expected FROM {catalog} c LEFT JOIN " + FIRST + " f ON f.catalog_id = c.id LEFT JOIN " + ITEMS + " i ON i.catalog_id = c.id)"


@query("SELECT catalog_id, kind, items, " + STATE.format("expected") + " AS summary_state, " + STATE.format("content_hash") + " AS simple_state FROM " + STATUS + " s")
def f8_summary_state(t):
    return records.derived_status(t.catalog, t.document, t.agenda_item).select("catalog_id", "kind", "items", "summary_state", "simple_state")


@query("SELECT catalog_id, kind, items, " + STATE.format("expected") + " AS summary_state FROM " + STATUS + " s")
def f9_derived_status(t):
    d = records.derived_status(t.catalog, t.document, t.agenda_item)
    return d.select("catalog_id", "kind", "items", "summary_state")


@query("SELECT DISTINCT id FROM {catalog} c WHERE coalesce(content, '') <> '' AND " + STATE.format("content_hash") + " <> 'fresh' AND id > 20 AND EXISTS (SELECT 1 FROM {document} d WHERE d.catalog_id = c.id) ORDER BY id LIMIT 100")
def w1_summary_backlog(t):
    return records.backlog(t.catalog, t.document, 20, 100)


@query("SELECT catalog_id, min(CASE WHEN category = 'agenda' AND h.event_id IS NOT NULL THEN 0 WHEN category = 'agenda' THEN 1 ELSE 2 END) AS priority FROM {document} d LEFT JOIN (SELECT DISTINCT event_id FROM {document} x WHERE category = 'agenda_html') h ON h.event_id = d.event_id GROUP BY 1")
def j10_sibling_priority(t):
    return records.sibling_priority(t.document)


RUNS = [(c, dt.datetime(1996, m, 1), dt.datetime(1996, m + 1, 15)) for c in ("nation_6", "nation_12") for m in (1, 6)]
RUN_SQL = " UNION ALL ".join(f"SELECT '{c}' AS city, TIMESTAMP '{a}' AS started, TIMESTAMP '{b}' AS finished" for c, a, b in RUNS)


@query("SELECT DISTINCT source AS city, SHA(name) AS url_hash FROM (SELECT source, concat(CAST(id % 500 AS VARCHAR), meeting_type) AS name, record_date FROM {event}) e JOIN (" + RUN_SQL + ") r ON r.city = e.source AND CAST(e.record_date AS TIMESTAMP) BETWEEN started AND finished")
def j7_run_window(t):
    runs_ = t._spark.createDataFrame(RUNS, "city string, started timestamp, finished timestamp")
    staged = t.event.select(F.col("source").alias("city"), F.sha2(F.concat((F.col("id") % 500).cast("string"), "meeting_type"), 256).alias("url_hash"), F.col("record_date").cast("timestamp").alias("created_at"))
    return records.run_window_rows(runs_, staged)


@query("SELECT DISTINCT url_hash FROM (SELECT l_partkey AS url_hash FROM {lineitem} UNION ALL SELECT p_partkey FROM {part}) u")
def u6_touched_hashes(t):
    return records.touched_hashes(t.lineitem.select(F.col("l_partkey").alias("url_hash")), t.part.select(F.col("p_partkey").alias("url_hash")))


@query("SELECT p.name AS place, coalesce(e.n, 0) AS events, coalesce(d.n, 0) AS documents, coalesce(d.c, 0) AS catalogs, coalesce(o.n, 0) AS organizations FROM {place} p LEFT JOIN (SELECT place_id, count(*) AS n FROM {event} GROUP BY 1) e ON e.place_id = p.id LEFT JOIN (SELECT place_id, count(*) AS n, count(DISTINCT catalog_id) AS c FROM {document} d JOIN {event} e ON e.id = d.event_id GROUP BY 1) d ON d.place_id = p.id LEFT JOIN (SELECT place_id, count(*) AS n FROM {organization} GROUP BY 1) o ON o.place_id = p.id")
def a7_place_counts(t):
    return records.place_counts(t.place, t.event, t.document, t.organization)


@query("SELECT (SELECT count(*) FROM {catalog}) AS catalogs, (SELECT count(*) FROM {catalog} WHERE coalesce(content, '') <> '') AS processed, (SELECT count(*) FROM {catalog} WHERE coalesce(summary, '') <> '') AS summarized, (SELECT count(*) FROM {event}) AS events, (SELECT CAST(max(record_date) AS VARCHAR) FROM {event}) AS latest, (SELECT datediff('day', max(record_date), DATE '2001-08-01') > 7 FROM {event}) AS stale")
def a8_freshness(t):
    return records.freshness(t.catalog, t.event, dt.date(2001, 8, 1)).withColumn("latest", F.col("latest").cast("string"))


AUDIT = """
WITH cal AS (SELECT CAST(unnest(generate_series(TIMESTAMP '1997-04-01', TIMESTAMP '1998-03-01', INTERVAL 1 MONTH)) AS DATE) AS month),
e AS (SELECT id, record_date, name, CAST(date_trunc('month', record_date) AS DATE) AS month FROM {event} x WHERE source = 'nation_6' AND record_date BETWEEN DATE '1997-04-01' AND DATE '1998-03-20'),
m AS (SELECT month, count(DISTINCT id) AS events, count(DISTINCT concat(CAST(record_date AS VARCHAR), '|', lower(COLLAPSE(name)))) AS meetings FROM e GROUP BY 1),
a AS (SELECT e.month, d.catalog_id, coalesce(content, '') <> '' AS has, coalesce(summary, '') <> '' AS summed FROM e JOIN {document} d ON d.event_id = e.id JOIN {catalog} c ON c.id = d.catalog_id WHERE d.category IN ('agenda', 'agenda_html')),
k AS (SELECT month, count(*) AS agenda_documents, count(DISTINCT catalog_id) AS agenda_catalogs, count(DISTINCT catalog_id) FILTER (has) AS with_content, count(DISTINCT catalog_id) FILTER (summed) AS with_summary FROM a GROUP BY 1),
z AS (SELECT cal.month, coalesce(events, 0) AS events, coalesce(meetings, 0) AS meetings, coalesce(agenda_documents, 0) AS agenda_documents, coalesce(agenda_catalogs, 0) AS agenda_catalogs, coalesce(with_content, 0) AS with_content, coalesce(with_summary, 0) AS with_summary FROM cal LEFT JOIN m USING (month) LEFT JOIN k USING (month)),
y AS (SELECT *, median(meetings) OVER () AS median_meetings FROM z)
SELECT CAST(month AS VARCHAR) AS month, events, meetings, agenda_documents, agenda_catalogs, with_content, with_summary, median_meetings,
  concat_ws(',', CASE WHEN meetings = 0 THEN 'no_meetings' END, CASE WHEN median_meetings >= 2 AND meetings < ceil(median_meetings * 0.5) AND month < DATE '1998-03-01' THEN 'low_cadence' END, CASE WHEN meetings > 0 AND agenda_documents = 0 THEN 'no_agendas' END, CASE WHEN agenda_catalogs > 0 AND with_content < agenda_catalogs THEN 'missing_content' END, CASE WHEN with_content > 0 AND with_summary < with_content THEN 'missing_summaries' END) AS flags
FROM y"""


@query(AUDIT)
def a4_coverage_audit(t):
    return records.coverage_audit(t.event, t.document, t.catalog, "nation_6", dt.date(1998, 3, 20)).withColumn("month", F.col("month").cast("string"))


@query("SELECT count(*) AS n FROM {event} WHERE ocd_division_id = 'ocd-division/country:us/state:ca/place:nation_6' AND record_date >= DATE '1996-01-01' AND record_date <= DATE '1996-06-30'")
def a24_crawl_evidence(t):
    return records.crawl_evidence(t.event.withColumn("created_at", F.col("record_date").cast("timestamp")), "ocd-division/country:us/state:ca/place:nation_6", dt.datetime(1996, 1, 1), dt.datetime(1996, 6, 30))


@query("SELECT source, CAST(max(record_date) AS VARCHAR) AS latest, count(*) AS n FROM {event} GROUP BY 1")
def a25_verification_baseline(t):
    return records.verification_baseline(t.event).withColumn("latest", F.col("latest").cast("string"))


@query("SELECT id, concat_ws(',', CASE WHEN coalesce(name, '') = '' THEN 'name' END, CASE WHEN record_date IS NULL THEN 'record_date' END, CASE WHEN NOT coalesce(starts_with(ocd_division_id, 'ocd-'), false) THEN 'ocd_division_id' END) AS reasons FROM {event_stage}")
def f16_validated(t):
    return records.validated(t.event_stage).select("id", "reasons")


@query("SELECT s.id, CASE WHEN p.id IS NULL THEN 'blocked' WHEN EXISTS (SELECT 1 FROM {event} e WHERE e.place_id = p.id AND e.record_date IS NOT DISTINCT FROM s.record_date AND e.name = s.name) OR row_number() OVER (PARTITION BY p.id, s.record_date, s.name ORDER BY s.id) > 1 THEN 'duplicate' ELSE 'promoted' END AS outcome FROM {event_stage} s LEFT JOIN {place} p ON p.ocd_division_id = s.ocd_division_id")
def u1_promote(t):
    return records.promote(t.event_stage, t.event, t.place).select("id", "outcome")


@query("WITH s AS (SELECT CASE WHEN id % 5 = 0 THEN concat('ocd-division/place:', CAST(id AS VARCHAR)) ELSE ocd_division_id END AS d, CASE WHEN id % 2 = 0 THEN name ELSE concat(name, ' city') END AS n, CASE WHEN id % 5 = 0 THEN 'XX' ELSE state END AS s FROM {place}) SELECT coalesce(s.d, p.ocd_division_id) AS ocd_division_id, coalesce(s.n, p.name) AS name, coalesce(s.s, p.state) AS state, CASE WHEN s.d IS NOT NULL THEN replace(replace(s.n, ' ', ''), '_', '') END AS client, CASE WHEN p.id IS NULL THEN 'insert' WHEN s.d IS NULL THEN 'keep' WHEN p.name = s.n AND p.state = s.s THEN 'same' ELSE 'update' END AS change FROM {place} p FULL JOIN s ON s.d = p.ocd_division_id")
def u2_upsert_places(t):
    p = t.place
    new = F.col("id") % 5 == 0
    seeds = p.select(F.when(new, F.concat(F.lit("ocd-division/place:"), F.col("id").cast("string"))).otherwise(F.col("ocd_division_id")).alias("ocd_division_id"), F.when(F.col("id") % 2 == 0, F.col("name")).otherwise(F.concat("name", F.lit(" city"))).alias("name"), F.when(new, "XX").otherwise(F.col("state")).alias("state"))
    seeds = seeds.withColumn("hosting", F.lit("Legistar")).withColumn("url", F.concat(F.lit("https://"), F.translate("name", " _", ""), F.lit(".legistar.com/Calendar.aspx")))
    return records.upsert_places(p, seeds)


BODIES = "(SELECT id, place_id, CASE name WHEN 'BUILDING' THEN 'City Council' WHEN 'MACHINERY' THEN 'Planning Commission' WHEN 'FURNITURE' THEN 'Parks Commission' ELSE name END AS name FROM {organization} o)"
KINDS = "(SELECT id, place_id, organization_id, concat(meeting_type, CASE id % 5 WHEN 0 THEN ' Planning Commission' WHEN 1 THEN ' planning board' WHEN 2 THEN ' PARKS' ELSE '' END) AS meeting_type FROM {event} e)"


@query("WITH b AS (SELECT *, CASE WHEN lower(meeting_type) LIKE '%planning commission%' OR lower(meeting_type) LIKE '%planning board%' THEN 'Planning Commission' WHEN lower(meeting_type) LIKE '%parks%' THEN 'Parks Commission' ELSE 'City Council' END AS body FROM " + KINDS + " k), o AS (SELECT place_id, name, min(id) AS body_id FROM " + BODIES + " x GROUP BY 1, 2) SELECT b.id, body, body_id, organization_id IS DISTINCT FROM body_id AS changed FROM b LEFT JOIN o ON o.place_id = b.place_id AND o.name = body")
def u3_backfill_organizations(t):
    return records.backfill_organizations(from_sql(t, "SELECT * FROM " + KINDS + " k"), from_sql(t, "SELECT * FROM " + BODIES + " o")).select("id", "body", F.col("body_id").cast("long").alias("body_id"), "changed")


@query("WITH s AS (SELECT vec_id AS c, CAST(vec_id % 7 AS VARCHAR) AS h FROM {embeddings}), i AS (SELECT vec_id + 9 AS c, CAST((vec_id + 9) % 14 AS VARCHAR) AS h FROM {embeddings}) SELECT coalesce(s.c, i.c) AS catalog_id, CASE WHEN i.c IS NULL THEN 'kept' WHEN s.c IS NULL THEN 'inserted' WHEN s.h = i.h THEN 'cached' ELSE 'updated' END AS status FROM s FULL JOIN i ON i.c = s.c")
def u5_upsert_embeddings(t):
    e = t.embeddings.select(F.col("vec_id").alias("catalog_id"))
    stored = e.select("catalog_id", (F.col("catalog_id") % 7).cast("string").alias("source_hash"), F.lit("driver").alias("model_name"))
    return records.upsert_embeddings(stored, e.select(F.col("catalog_id") + 9).toDF("catalog_id").select("catalog_id", (F.col("catalog_id") % 14).cast("string").alias("source_hash")), "driver")


@query("SELECT id, brand, CAST(NULL AS VARCHAR) AS content, CAST(NULL AS VARCHAR) AS content_hash, CAST(NULL AS VARCHAR) AS summary, true AS no_topics FROM {catalog}")
def u10_purge_derived(t):
    return records.purge_derived(t.catalog).select("id", "brand", "content", "content_hash", "summary", F.col("topics").isNull().alias("no_topics"))


@query("SELECT id, content_hash FROM {catalog}")
def u13_backfill_hashes(t):
    emptied = t.catalog.withColumn("content_hash", F.when(F.col("id") % 2 == 0, F.col("content_hash")))
    return records.backfill_hashes(emptied).select("id", "content_hash")


@query("SELECT conv_id, turn, CASE WHEN e.id IS NULL THEN 'unknown_event' WHEN role = 'user' THEN NULL ELSE 'issue_type' END AS reason FROM {conversations} c LEFT JOIN {event} e ON e.id = c.conv_id * 7 WHERE length(c.text) <= 500 OR e.id IS NULL OR role <> 'user' UNION ALL SELECT conv_id, turn, 'description' FROM {conversations} c JOIN {event} e ON e.id = c.conv_id * 7 WHERE length(c.text) > 500 AND role = 'user'")
def u14_report_issues(t):
    issues = t.conversations.select("conv_id", "turn", (F.col("conv_id") * 7).alias("event_id"), F.when(F.col("role") == "user", "garbled_text").otherwise("typo").alias("issue_type"), F.col("text").alias("description"))
    return records.report_issues(issues, t.event).select("conv_id", "turn", "reason")


@query("SELECT event_id, CASE WHEN value > 20 THEN 0 ELSE user_id % 4 + 1 END AS attempts, CASE WHEN value > 20 THEN 'complete' WHEN user_id % 4 + 1 >= 3 THEN 'failed_terminal' ELSE 'failed' END AS state, CASE WHEN value <= 20 THEN substring(props, 1, 500) END AS error FROM {events}")
def u15_extraction_state(t):
    return t.events.select("event_id", *(c.alias(n) for n, c in records.extraction_state(F.col("value") > 20, F.col("user_id") % 4, F.col("props")).items()))


@query("SELECT id, catalog_id, running_chars FROM (SELECT id, catalog_id, sum(length(title)) OVER (PARTITION BY catalog_id ORDER BY item_order ROWS UNBOUNDED PRECEDING) AS running_chars FROM {agenda_item}) r WHERE running_chars <= 10000")
def w7_character_budget(t):
    return records.character_budget(t.agenda_item, 10000).select("id", "catalog_id", "running_chars")


@query("SELECT doc_id, COLLAPSE(text) AS collapsed FROM {documents}")
def x1_collapse(t):
    return t.documents.select("doc_id", X.collapse(F.col("text")).alias("collapsed"))


@query("SELECT doc_id, CASE WHEN c <> '' THEN SHA(c) END AS content_hash, CASE WHEN length(c) >= 20 THEN SHA(substring(c, 1, 4000)) END AS semantic_hash FROM (SELECT doc_id, COLLAPSE(text) AS c FROM {documents}) d")
def x2_content_hash(t):
    return t.documents.select("doc_id", X.content_hash(F.col("text")).alias("content_hash"), X.semantic_hash(F.col("text")).alias("semantic_hash"))


@query("SELECT o_orderkey AS id, concat('$', CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR), '|$5 million') AS snippets FROM {orders}")
def x11_money_snippets(t):
    price = F.concat(F.lit("$"), F.floor("o_totalprice").cast("string"))
    said = F.concat(F.lit("Cost "), price, F.lit("; and $5 million, not $5 MILLION; again "), price, F.lit("."))
    return t.orders.select(F.col("o_orderkey").alias("id"), F.concat_ws("|", X.money_snippets(said)).alias("snippets"))


@query("SELECT doc_id, lower(topic) NOT IN (" + NOISE + ") AS kept FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'Roll  Call' WHEN doc_id % 4 = 1 THEN ' staff report' ELSE source END AS t0, COLLAPSE(CASE WHEN doc_id % 4 = 0 THEN 'Roll  Call' WHEN doc_id % 4 = 1 THEN ' staff report' ELSE source END) AS topic FROM {documents}) d")
def f12_trend_noise(t):
    topic = F.when(F.col("doc_id") % 4 == 0, "Roll  Call").when(F.col("doc_id") % 4 == 1, " staff report").otherwise(F.col("source"))
    return t.documents.select("doc_id", (~X.is_trend_noise(topic)).alias("kept"))


@query("SELECT id, CASE WHEN length(title) > 0 AND hit > 0 THEN substring(content, greatest(1, hit - 500), hit + length(title) + 1000 - greatest(1, hit - 500)) END AS window FROM (SELECT i.id, i.title, c.content, strpos(lower(c.content), lower(i.title)) AS hit FROM {agenda_item} i JOIN {catalog} c ON c.id = i.catalog_id) x")
def x20_context_window(t):
    return context_windows(t.agenda_item.select("id", "catalog_id", "title"), t.catalog.select(F.col("id").alias("catalog_id"), "content"), "catalog_id")


@query("SELECT arm, count(*) AS n, round(avg(section_compliance_pass), 6) AS compliance_rate, round(avg(fallback_used), 6) AS fallback_rate, quantile_disc(duration_ms, 0.95) AS p95_ms, median(duration_ms) FILTER (duration_ms > 0) AS median_ms, CAST(sum(total_tokens) AS BIGINT) AS total_tokens FROM {ab_row} GROUP BY 1")
def a13_arm_aggregate(t):
    return runs.arm_aggregate(t.ab_row)


ARMS = "(SELECT arm, round(avg(section_compliance_pass), 6) AS c, round(avg(fallback_used), 6) AS f, quantile_disc(duration_ms, 0.95) AS p FROM {ab_row} GROUP BY 1)"


@query("WITH g AS " + ARMS + ", d AS (SELECT round(100 * (b.c - a.c), 4) AS compliance_delta_pp, round(100 * (b.f - a.f), 4) AS fallback_delta_pp, round(100 * (b.p - a.p) / a.p, 4) AS p95_delta_percent FROM g a, g b WHERE a.arm = 'A' AND b.arm = 'B') SELECT *, compliance_delta_pp >= -5 AS compliance_ok, fallback_delta_pp <= 5 AS fallback_ok, p95_delta_percent <= 20 AS p95_ok FROM d")
def a14_arm_gates(t):
    return runs.arm_gates(runs.arm_aggregate(t.ab_row))


@query("SELECT phase, ms / 1000 AS total_s, spans, round(ms / sum(ms) OVER (), 6) AS share, row_number() OVER (ORDER BY ms DESC, phase) AS rank FROM (SELECT phase, sum(CAST(round(duration_s * 1000) AS BIGINT)) AS ms, count(*) AS spans FROM {span} GROUP BY 1) t QUALIFY rank <= 3")
def a15_bottlenecks(t):
    return runs.bottlenecks(t.span)


BOUNDS = "(SELECT unnest([" + ", ".join(map(str, runs.BUCKETS)) + ", 'infinity'::DOUBLE]) AS le)"


@query("SELECT phase, CASE WHEN isinf(le) THEN -1 ELSE le END AS le, count(*) FILTER (duration_s <= le) AS n FROM {span}, " + BOUNDS + " b GROUP BY 1, 2")
def m2_phase_histogram(t):
    return runs.phase_histogram(t.span).withColumn("le", F.when(F.col("le") == float("inf"), -1.0).otherwise(F.col("le")))


@query("WITH h AS (SELECT phase, le, count(*) FILTER (duration_s <= le) AS n FROM {span}, " + BOUNDS + " b GROUP BY 1, 2), w AS (SELECT *, coalesce(lag(n) OVER (PARTITION BY phase ORDER BY le), 0) AS below, coalesce(lag(le) OVER (PARTITION BY phase ORDER BY le), 0) AS low, 0.9 * max(n) OVER (PARTITION BY phase) AS target FROM h), f AS (SELECT *, row_number() OVER (PARTITION BY phase ORDER BY le) AS k FROM w WHERE n >= target AND target > 0) SELECT phase, round(CASE WHEN isinf(le) THEN low WHEN n = below THEN low ELSE low + (le - low) * (target - below) / (n - below) END, 6) AS value FROM f WHERE k = 1")
def a16_histogram_quantile(t):
    return runs.histogram_quantile(runs.phase_histogram(t.span), 0.9)


@query("SELECT phase, arg_max(event_id, (duration_s, event_id)) AS event_id, max(duration_s) AS duration_s FROM {span} GROUP BY 1")
def a18_slowest(t):
    return runs.slowest(t.span)


@query("SELECT k.status, count(e.phase) AS n FROM (SELECT unnest(['click', 'view', 'missing', 'other']) AS status) k LEFT JOIN (SELECT CASE WHEN phase IN ('click', 'view', 'missing') THEN phase ELSE 'other' END AS phase FROM {span}) e ON e.phase = k.status GROUP BY 1")
def a22_status_counts(t):
    return runs.status_counts(t.span, "phase", ["click", "view", "missing"])


@query("SELECT user_id, event_id, CASE WHEN v >= b THEN v - b END AS delta, CASE WHEN b IS NULL OR v < b THEN v ELSE v - b END AS reset_delta FROM (SELECT user_id, event_id, CAST(floor(value) AS BIGINT) AS v, lag(CAST(floor(value) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM {events}) s")
def w9_counter_deltas(t):
    return runs.counter_deltas(t.events.select("user_id", "event_id", F.floor("value").alias("v")), "user_id", "event_id", "v")


@query("SELECT name, label, sum(value) AS total FROM (SELECT concat('m_', event_type) AS name, CAST(user_id AS VARCHAR) AS label, round(value, 2) AS value FROM {events} WHERE event_id % 3 <> 0) e GROUP BY 1, 2")
def s4_metric_lines(t):
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("# HELP "), "event_type")).otherwise(F.concat(F.lit("m_"), "event_type", F.lit('{user="'), F.col("user_id").cast("string"), F.lit('",kind="x"} '), F.format_string("%.2f", F.round("value", 2))))
    return runs.metric_lines(t.events.select(text.alias("value"))).groupBy("name", F.col("labels")["user"].alias("label")).agg(F.sum("value").alias("total"))
