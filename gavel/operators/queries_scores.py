"""Queries of scores and gates with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from gavel.operators import scores, titles
from gavel.operators.queries_documents import PROCEDURE, listed, matches, quoted
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


def holds(c: str, words) -> str:
    return "(" + " OR ".join(f"contains({c}, {quoted(w)})" for w in words) + ")"


#: Every line of every document as a name, some in shapes that the rules know.
NAMES = """(SELECT id, CASE item_order % 16 WHEN 0 THEN 'Maria Lopez' WHEN 1 THEN concat('City of ', title) WHEN 2 THEN 'J A N E D' WHEN 3 THEN 'maria de lopez' WHEN 4 THEN 'Brrrght Krshnttw' WHEN 5 THEN 'Doe v. Roe' WHEN 6 THEN ' Ana ' WHEN 7 THEN 'CLERK' WHEN 8 THEN 'Jo Ann 2' WHEN 9 THEN 'The Smith' WHEN 10 THEN 'MARIA ANNA LOPEZ' WHEN 11 THEN 'Ana Paz.' WHEN 12 THEN NULL WHEN 13 THEN regexp_extract(title, '^\\\\S+\\\\s+\\\\S+', 0) WHEN 14 THEN initcap_(regexp_extract(title, '^\\\\S+\\\\s+\\\\S+', 0)) ELSE title END AS name FROM {agenda_item} a)""".replace("initcap_(", "UPPER(")
# Spark's SQL strings read a doubled backslash as one; DuckDB's take it as it is
DUCK_NAMES = NAMES.replace("\\\\", "\\")
SPARK_NAMES = NAMES.replace(r"\\S", r"[^\\t\\n\\f\\r ]").replace(r"\\s", r"[\\t\\n\\f\\r ]")
N = "regexp_replace(coalesce(name, ''), '^\\s+|\\s+$', '', 'g')"


def human(single: bool) -> str:
    words = "len(regexp_split_to_array(n, '\\s+'))"
    vowels = "length(regexp_replace(lower(n), '[^aeiouy]', '', 'g'))"
    return (
        "(n <> '' AND NOT regexp_matches(n, '^(?:[A-Za-z]\\s+){3,}[A-Za-z]$') AND NOT (n = upper(n) AND n <> lower(n) AND length(n) > 15) AND NOT regexp_matches(n, '\\p{Nd}') AND regexp_matches(n, '[\\p{L}\\p{N}]$') AND "
        + words + " <= 4 AND " + ("TRUE" if single else words + " >= 2 AND lower(n) NOT IN " + listed(scores.NAME_CONTEXT)) + " AND NOT (" + words + " >= 3 AND n = lower(n)) AND NOT regexp_matches(lower(n), '^the(\\s|$)|(^|\\s)the$') AND NOT (length(n) > 5 AND " + vowels + " = 0) AND NOT (length(n) > 10 AND " + vowels + " / length(n) < 0.1) AND NOT "
        + holds("lower(n)", scores.NAME_MARKS) + " AND NOT " + matches("lower(n)", scores.NAME_NOISE) + ")"
    )


@query("SELECT id, " + human(False) + " AS likely, " + human(True) + " AS likely_single FROM (SELECT id, " + N + " AS n FROM " + DUCK_NAMES + " a) b")
def f14_human_names(t):
    d = from_sql(t, "SELECT * FROM " + SPARK_NAMES + " a")
    return d.select("id", scores.is_human_name(F.col("name")).alias("likely"), scores.is_human_name(F.col("name"), True).alias("likely_single"))


#: Every line of every document as an item, with descriptions and results, some in words that the rules know.
ITEMS = """(SELECT id, catalog_id, item_order, CASE WHEN (item_order + catalog_id) % 5 = 0 THEN NULL ELSE page_number END AS page_number, CASE WHEN catalog_id % 4 = 0 THEN title ELSE CASE (item_order + catalog_id) % 19 WHEN 0 THEN '1. Call to Order' WHEN 1 THEN concat('Approve the contract for ', title) WHEN 2 THEN '12 / 34 $5 #6 7% a' WHEN 3 THEN concat(title, ' Phone: 555-123-4567') WHEN 4 THEN 'Maria Lopez' WHEN 5 THEN 'B. Ordinance on zoning' WHEN 6 THEN '  ' WHEN 7 THEN concat('Join the webinar ', title) WHEN 8 THEN 'P A R K S x' WHEN 9 THEN 'City Council' WHEN 10 THEN 'Fees    12 14 90 and a b' WHEN 11 THEN concat('The state of emergency on water and its long continued effects ', title) WHEN 12 THEN 'Agenda Reports' ELSE title END END AS title, CASE item_order % 3 WHEN 0 THEN NULL WHEN 1 THEN 'Adopt the resolution on zoning and its budget' ELSE substring(title, 1, 12) END AS description, CASE WHEN item_order % 5 = 1 THEN ' Passed ' ELSE ' ' END AS result FROM {agenda_item} a)"""
T, D = "COLLAPSE(coalesce(title, ''))", "COLLAPSE(coalesce(description, ''))"
BOTH = "concat(lower(" + T + "), ' ', lower(" + D + "))"
CONTACTED = "(" + matches("trim(" + BOTH + ")", titles.CONTACT_PATTERNS) + " OR regexp_matches(lower(" + T + "), '^(from:|to:|cc:)'))"
RAW = "concat(coalesce(title, ''), ' ', coalesce(description, ''))"
SCORE = "greatest(0, least(100, 20 + CASE WHEN length(" + T + ") >= 10 THEN 15 ELSE 0 END - CASE WHEN " + PROCEDURE + " THEN 45 ELSE 0 END - CASE WHEN " + CONTACTED + " THEN 45 ELSE 0 END + CASE WHEN " + holds(BOTH, scores.LEGISLATIVE) + " THEN 35 ELSE 0 END + CASE WHEN " + holds(BOTH, scores.ACTIONS) + " THEN 15 ELSE 0 END + CASE WHEN length(" + D + ") >= 24 THEN 20 ELSE 0 END))"
TABLE_PARTS = "SELECT *, COLLAPSE(raw) AS text, string_split(lower(COLLAPSE(raw)), ' ') AS tokens FROM (SELECT *, " + SCORE + " AS points, " + RAW + " AS raw, item_order % 2 = 0 AS parent FROM " + ITEMS + " a) b"
SHARE = "(CAST(len(list_filter(tokens, lambda x: regexp_matches(x, '[0-9$%/|#]'))) AS DOUBLE) / len(tokens))"
SIGNS = "(CAST(regexp_matches(regexp_replace(raw, '^\\s+|\\s+$', '', 'g'), '\\t| {3,}') AS INTEGER) + CAST(parent AND regexp_matches(" + T + ", " + quoted(scores.SUB_MARKER) + ") AS INTEGER) + CAST(" + SHARE + " >= 0.35 AS INTEGER) + CAST(len(tokens) >= 5 AND NOT " + holds("lower(text)", scores.VERBS) + " AS INTEGER))"
TABULAR = "(text <> '' AND length(text) <= 180 AND ((length(text) <= 150 AND CAST(length(regexp_replace(text, '[^\\p{L}]+', '', 'g')) AS DOUBLE) / length(text) < 0.6 AND " + SHARE + " >= 0.25) OR (parent AND " + SIGNS + " >= 2) OR (" + SIGNS + " >= 3 AND length(text) <= 120)))"


@query("SELECT id, CAST(points AS DOUBLE) / 100 AS score, " + TABULAR + " AS tabular FROM (" + TABLE_PARTS + ") p")
def x13_substance(t):
    d = from_sql(t, "SELECT *, item_order % 2 = 0 AS parent FROM " + ITEMS + " a")
    title, description = F.col("title"), F.col("description")
    return d.select("id", scores.substance_score(title, description).alias("score"), scores.is_tabular(title, description, F.col("parent")).alias("tabular"))


# acceptance looks at collapsed texts, so gaps in them are no sign
ACCEPTED_PARTS = TABLE_PARTS.replace(RAW + " AS raw", "concat(" + T + ", ' ', " + D + ") AS raw")


@query("SELECT id, length(" + T + ") >= 10 AND NOT " + PROCEDURE + " AND NOT " + CONTACTED + " AND NOT " + TABULAR + " AND points >= 28 AS recall, length(" + T + ") >= 10 AND NOT " + PROCEDURE + " AND NOT " + CONTACTED + " AND NOT " + TABULAR + " AND points >= 58 AS aggressive FROM (" + ACCEPTED_PARTS + ") p")
def x13_accepted_items(t):
    d = from_sql(t, "SELECT *, item_order % 2 = 0 AS parent FROM " + ITEMS + " a")
    cells = (F.col("title"), F.col("description"), F.col("parent"))
    return d.select("id", scores.accepted_item(*cells, "recall").alias("recall"), scores.accepted_item(*cells, "aggressive").alias("aggressive"))


def worth(items: str, keys: str) -> str:
    """SQL of keys, items, score, low for the rows of items."""
    low = "lower(" + T + ")"
    hits = [(matches(low, titles.BOILERPLATE_PATTERNS), 18), ("(regexp_matches(" + low + ", '\\bstate of emergency\\b') AND length(" + low + ") > 60)", 12), *((f"regexp_matches({low}, {quoted(p)})", w) for p, w in scores.PENALTIES)]
    words = "string_split(" + low + ", ' ')"
    singles = "(CAST(len(list_filter(" + words + ", lambda x: regexp_matches(x, '^\\p{L}$'))) AS DOUBLE) / len(" + words + ") >= 0.6)"
    name = "(regexp_matches(" + T + ", " + quoted(scores.NAME_PATTERN) + ") AND NOT list_has_any(list_transform(" + words + ", lambda x: trim(x, '.')), [" + ", ".join(map(quoted, scores.NOT_NAMES)) + "]))"
    loss = " + ".join(f"CAST({c} AS INTEGER) * {w}" for c, w in [*hits, (PROCEDURE, 14), (CONTACTED, 14), (name, 10), (singles, 20), (f"regexp_matches({low}, {quoted(scores.MEETING_WORDS)})", 12), ("(length(" + T + ") < 6)", 15), ("(COLLAPSE(coalesce(result, '')) <> '')", -2)])
    row = f"SELECT *, {T} <> '' AS given, {low} AS k, page_number IS NULL OR page_number = 1 AS p1, {PROCEDURE} AS pr, {CONTACTED} AS co, {name} AS nl, {' + '.join(f'CAST({c} AS INTEGER)' for c, _ in hits)} AS h, {loss} AS l FROM {items} i0"
    n = "CAST({} * CAST({} AS DOUBLE) AS DOUBLE)"
    part = lambda x: "floor(" + n.format("n", x) + ")"
    g = f"SELECT {keys}, count(*) AS n, sum(CASE WHEN given THEN l ELSE 25 END) AS loss, count(*) FILTER (given) AS t, count(DISTINCT k) FILTER (given) AS u, count(*) FILTER (p1) AS p1, coalesce(sum(h) FILTER (given), 0) AS h, count(*) FILTER (given AND pr) AS pr, count(*) FILTER (given AND co) AS co, count(*) FILTER (given AND nl) AS nl FROM ({row}) r GROUP BY {keys}"
    group = f"CASE WHEN n < 3 THEN 0 ELSE CASE WHEN h >= 1 AND h >= {part(0.34)} THEN 15 ELSE 0 END + CASE WHEN pr >= greatest(1, {part(0.34)}) THEN 12 ELSE 0 END + CASE WHEN co >= greatest(1, {part(0.25)}) THEN 14 ELSE 0 END + CASE WHEN nl >= 2 AND nl >= {part(0.5)} THEN 15 ELSE 0 END + CASE WHEN 1.0 - CAST(u AS DOUBLE) / greatest(1, t) >= 0.25 THEN 10 ELSE 0 END END"
    return f"(SELECT {keys}, n AS items, CAST(greatest(0, least(100, 100 - loss - 15 * (t - u) - CASE WHEN p1 >= greatest(1, {part(0.8)}) THEN 20 ELSE 0 END - {group})) AS BIGINT) AS score FROM ({g}) g)"


@query("SELECT catalog_id, items, score, score < 45 AS low FROM " + worth(ITEMS, "catalog_id") + " w")
def a11_agenda_quality(t):
    return scores.quality_scores(from_sql(t, "SELECT * FROM " + ITEMS + " a"), "catalog_id")


# three sources of every catalog's items, from its own lines in other words; two pages for each event
PORTAL = ITEMS.replace("FROM {agenda_item} a", "FROM {agenda_item} a WHERE catalog_id % 3 = 0 OR item_order < 2")
HTML = "(SELECT i.*, k AS source_id FROM " + ITEMS + " i JOIN (SELECT 7 AS k UNION ALL SELECT 4 AS k) s ON k = 7 OR item_order % 2 = 0 WHERE catalog_id % 5 <> 0)"
FALLBACK = "(SELECT id, catalog_id, item_order, page_number, CASE WHEN item_order % 2 = 0 THEN lower(title) ELSE concat('Item ', title) END AS title, description, result FROM " + ITEMS + " f)"
LOWT = "lower(" + T + ")"
PORTAL_KEPT = "(SELECT id, catalog_id, item_order, page_number, " + T + " AS title, description, result FROM " + PORTAL + " p WHERE " + T + " <> '' AND (starts_with(" + LOWT + ", 'subject:') OR NOT (" + matches(LOWT, titles.PORTAL_PROCEDURE) + " OR " + LOWT + " IN " + listed(titles.PORTAL_SECTIONS) + " OR " + matches(LOWT, titles.PORTAL_NOTICES) + " OR (length(" + LOWT + ") >= 180 AND NOT (contains(" + LOWT + ", 'public hearing') OR contains(" + LOWT + ", 'subject:') OR contains(" + LOWT + ", 'application no'))))))"
CONTACT_ONE = "(" + matches(LOWT, titles.CONTACT_PATTERNS) + " OR regexp_matches(" + LOWT + ", '^(from:|to:|cc:)'))"
SOURCES = (
    "WITH kept AS " + PORTAL_KEPT + ", ok AS (SELECT catalog_id FROM kept GROUP BY 1 HAVING count(*) >= 3 AND count(*) FILTER (NOT " + PROCEDURE + " AND NOT " + CONTACT_ONE + ") >= 3), html AS " + HTML + ", "
    "best AS (SELECT * FROM " + worth("html", "catalog_id, source_id") + " w QUALIFY row_number() OVER (PARTITION BY catalog_id ORDER BY score DESC, source_id) = 1), "
    "choice AS (SELECT c.id AS catalog_id, source_id, best.items AS pages, CASE WHEN ok.catalog_id IS NOT NULL THEN 'portal' WHEN best.items >= 2 AND best.score >= 55 THEN 'html' ELSE 'fallback' END AS source FROM (SELECT DISTINCT catalog_id AS id FROM {agenda_item}) c LEFT JOIN ok ON ok.catalog_id = c.id LEFT JOIN best ON best.catalog_id = c.id), "
    "page AS (SELECT h.*, source FROM html h JOIN choice c ON c.catalog_id = h.catalog_id AND c.source_id = h.source_id), own AS (SELECT f.* FROM " + FALLBACK + " f JOIN choice c ON c.catalog_id = f.catalog_id WHERE source = 'fallback' AND coalesce(pages, 0) < 3), "
    "late AS (SELECT * FROM page p WHERE source = 'fallback' AND EXISTS (SELECT 1 FROM choice c WHERE c.catalog_id = p.catalog_id AND c.pages >= 3) UNION ALL SELECT * FROM (SELECT * FROM page p WHERE source = 'fallback' AND EXISTS (SELECT 1 FROM choice c WHERE c.catalog_id = p.catalog_id AND c.pages < 3) QUALIFY row_number() OVER (PARTITION BY catalog_id, lower(title) ORDER BY item_order) = 1) p WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.catalog_id = p.catalog_id AND lower(o.title) = lower(p.title))), "
    "chosen AS (SELECT kept.catalog_id, item_order, title, description, result, page_number FROM kept JOIN choice USING (catalog_id) WHERE source = 'portal' UNION ALL SELECT catalog_id, item_order, title, description, result, page_number FROM page WHERE source = 'html' UNION ALL SELECT catalog_id, item_order, title, description, result, page_number FROM own UNION ALL SELECT catalog_id, item_order, title, description, result, page_number FROM late) "
)


def resolved(t):
    # rows worked out once: no filter moves below a generator
    table = lambda sql: from_sql(t, "SELECT * FROM " + sql + " x").select(F.inline(F.array(F.struct("*"))))
    return scores.resolved_sources(t.agenda_item.select("catalog_id").distinct(), table(PORTAL), table(HTML), table(FALLBACK.replace("lower(title)", "lower(replace(replace(title, '\u0130', 'i'), '\u03a3', '\u03c3'))")))


@query(SOURCES + "SELECT c.catalog_id, source, coalesce(items, 0) AS items, coalesce(score, 0) AS score, CASE WHEN source = 'portal' THEN 'high' WHEN source = 'html' OR coalesce(items, 0) > 0 THEN 'medium' ELSE 'low' END AS confidence FROM choice c LEFT JOIN " + worth("chosen", "catalog_id") + " w ON w.catalog_id = c.catalog_id")
def u8_agenda_sources(t):
    return resolved(t)[1]


@query(SOURCES + "SELECT catalog_id, item_order, title FROM chosen")
def u8_resolved_items(t):
    return resolved(t)[0]


#: Every document, most behind numbered lines or numbers inside a line.
NUMBERED = """(SELECT doc_id, category, concat(CASE WHEN doc_id % 5 < 2 THEN concat('[Page 1]1. Approve the budget of  parks', chr(10), ' 2. Join by phone at noon today', chr(10), CASE WHEN doc_id % 2 = 0 THEN concat('3. APPROVE THE BUDGET OF PARKS', chr(10), '4. Short', chr(10), '5. Repair of the bridge ') ELSE '' END) WHEN doc_id % 5 < 4 THEN 'Flat 1. Hearing on the water fees 2. 3. Sale of land near the river 14. Mute' ELSE '' END, chr(10), coalesce(text, '')) AS text FROM (SELECT *, CASE doc_id % 3 WHEN 0 THEN 'Agenda ' WHEN 1 THEN 'minutes' ELSE 'agenda_html' END AS category FROM {documents}) d)"""
VALUE = "regexp_replace(regexp_replace(text, '(?i)\\[PAGE\\s+\\d+\\]', chr(10), 'g'), '[ \\t]+', ' ', 'g')"
STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
FIT = "lambda x: length(x) >= 10 AND NOT " + holds("lower(x)", scores.ATTENDANCE)


@query(
    "WITH v AS (SELECT doc_id, " + VALUE + " AS v FROM " + NUMBERED + " n), p AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(v, '(?m)^\\s*\\d+\\.\\s+(.+?)\\s*$', 1), lambda x: " + STRIP.format("x") + "), " + FIT + ")[:3] AS l, list_filter(list_transform(regexp_split_to_array(v, '\\b\\d{1,2}\\.\\s+')[2:], lambda x: " + STRIP.format("substring(" + STRIP.format("split_part(" + STRIP.format("x") + ", chr(10), 1)") + ", 1, 160)") + "), " + FIT + ") AS r FROM v), "
    "u AS (SELECT doc_id, generate_subscripts(f, 1) AS k, unnest(f) AS title FROM (SELECT doc_id, list_concat(l, r[:greatest(0, 3 - len(l))]) AS f FROM p) q) SELECT doc_id, title, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS rank FROM (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY doc_id, lower(title) ORDER BY k) = 1) w"
)
def x25_flat_titles(t):
    d = from_sql(t, "SELECT * FROM " + NUMBERED + " n").select("doc_id", F.posexplode(scores.flat_titles(F.col("text"))).alias("at", "title"))
    return d.select("doc_id", "title", (F.col("at") + 1).alias("rank"))


# DuckDB's \b knows ASCII only, so other letters become a word's character there
HINTS = holds("lower(line)", scores.ENTITY_HINTS)


@query(
    "WITH d AS (SELECT doc_id, lower(trim(category)) IN ('agenda', 'agenda_html') AS hinted, replace(text, 'the', 'The Mayor') AS text FROM " + NUMBERED + " n), l AS (SELECT doc_id, generate_subscripts(a, 1) AS k, COLLAPSE(unnest(a)) AS line FROM (SELECT doc_id, regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x{85}]') AS a FROM d WHERE hinted) x), "
    "h AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY k) - 1 AS upto, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS nth FROM l WHERE " + HINTS + "), j AS (SELECT doc_id, substring(string_agg(line, chr(10) ORDER BY k), 1, 24000) AS joined FROM h WHERE nth = 1 OR upto <= 24000 GROUP BY 1), "
    "c AS (SELECT d.doc_id, CASE WHEN hinted THEN coalesce(joined, substring(text, 1, 12000)) ELSE substring(text, 1, 16000) END AS line, hinted AND joined IS NULL AND text <> '' AS prefix_used FROM d LEFT JOIN j ON j.doc_id = d.doc_id) SELECT doc_id, line AS text, NOT " + HINTS + " AND len(regexp_extract_all(regexp_replace(line, '[^\\x00-\\x7F]', '_', 'g'), " + quoted(scores.NAME_CUE) + ")) < 2 AS low_signal, prefix_used FROM c"
)
def x21_entity_candidates(t):
    d = from_sql(t, "SELECT doc_id, category, replace(text, 'the', 'The Mayor') AS text FROM " + NUMBERED + " n")
    return d.select("doc_id", scores.entity_candidates(F.col("text"), F.col("category")).alias("c")).select("doc_id", "c.*")
