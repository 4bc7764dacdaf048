"""Rules on agenda titles and on whole texts: noise, acceptance, bad content, compliance, grounding, decoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavel.functions.text import SPACES, ascii_bounds, collapse, counted, lower, once, sql_pattern, texts_of
from gavel.operators.quality import BOILERPLATE_PATTERNS, is_boilerplate  # noqa: F401

#: Titles of procedure, whole and as patterns.
PROCEDURAL_TITLES = ("call to order", "roll call", "pledge of allegiance", "public comment", "adjournment", "closed session", "land acknowledgment", "land acknowledgement", "approval of minutes", "approval of the minutes", "approval of agenda", "approval of the agenda")
PROCEDURAL_PATTERNS = (r"^public comment(?:\s+period)?$", r"^ceremonial matters$", r"^presentations?$", r"^announcements?$")
#: Marks of contact lines, in lower-case text.
CONTACT_PATTERNS = (r"\b(tel|phone|fax|e-?mail|email|website)\s*:", r"\b[\w\.-]+@[\w\.-]+\.\w+\b", r"https?://|www\.", r"\b\d{3}[-\.\s]?\d{3}[-\.\s]?\d{4}\b", r"\b\d{2,6}\s+[a-z][a-z\.\s]+(street|st|avenue|ave|road|rd|blvd|boulevard)\b", r"office of the city manager")
#: Portal rows that are no agenda items.
PORTAL_PROCEDURE = (r"(?i)^call to order$", r"(?i)^roll call$", r"(?i)^public participation(?: and access)?$", r"(?i)^public comment$", r"(?i)^adjourn(?:ment| special meeting| regular meeting)?$", r"(?i)^convene to closed session$", r"(?i)^\d{1,2}:\d{2}\s*(?:a\.m\.|p\.m\.|am|pm)\s+.*meeting.*$")
PORTAL_SECTIONS = ("approval of minutes", "postponements", "oral communications", "written communications", "consent calendar", "public hearings", "old business", "new business", "staff and commission reports", "future agenda setting")
PORTAL_NOTICES = (r"\bteleconference\b", r"\bjoin the webinar\b", r"\bjoin by phone\b", r"\bmeeting id\b", r"\bpasscode\b", r"\braise hand\b", r"\bmembers? of the public\b", r"\bamericans with disabilities act\b", r"\bauxiliary aids\b", r"\bimportant notice\b", r"\bpublic records\b", r"\bwritten communications? sent\b", r"\byou may be limited to raising only those issues\b", r"\bquestions? on any items? in the agenda\b", r"\bthis portion of the meeting is reserved\b", r"\bunless there are separate discussions?\b")
#: Texts that a portal returns in place of a document.
ERROR_PAGE = (r"(?i)the system has encountered an error and could not complete your request", r"(?i)if the problem persists,\s*please contact the site administrator")
LOADING_SHELL = (r"(?i)\bloading\.\.\.", r"(?i)the url can be used to link to this page", r"(?i)your browser does not support the video tag")
#: Marks of a report on a single item, and of an agenda.
REPORT_STRONG = (r"(?i)\b(?:agenda|administrative)\s+report\b", r"(?im)^\s*to\s*:", r"(?im)^\s*from\s*:", r"(?im)^\s*subject\s*:", r"(?im)^\s*recommendations?\b\s*:?")
REPORT_SUPPORT = ("agenda number:", "section name:", "{{ section", "{{ item.tracking")
AGENDA_LINES = (r"(?im)^\s*(?:call to order|public comment|consent calendar|adjournment)\s*$", r"(?im)^\s*(?:consent\s+calendar|study\s+session|public\s+hearing|new\s+business|old\s+business)\s*$")
AGENDA_HEADING = r"(?im)^\s*(?:item\s*)?(?:\d{1,2}(?:\.\d+)?|[A-Z])[\.\):]\s+[A-Z][A-Za-z0-9/&'’()\- ]{3,85}$"
#: Sections and phrases of summaries.
SECTIONS = ("bluf:", "why this matters:", "top actions:", "potential impacts:", "unknowns:")
FALLBACKS = ("no substantive actions were retained after filtering", "agenda summary unavailable")
PARTIAL = (r"partial coverage", r"included\s+\d+\s+of\s+\d+\s+items", r"first\s+\d+\s+of\s+\d+")
HEADERS = ("why this matters:", "top actions:", "potential impacts:", "unknowns:", "major themes:", "decision/action requested:")
CLAIM_STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "to", "was", "were", "with", "this", "these", "those", "will", "would", "can", "could", "may", "might")
LEAST_COVERAGE = 0.45
#: An item's header in a model's answer, its page, and what parts a title from its description.
ITEM_HEADER = r"(?im)^\s*ITEM\s+(\d+)\s*:\s*"
ITEM_PAGE = r"(?is)^(.*?)\(\s*page\s*(\d+)\s*\)(.*)$"
ITEM_DASH = r"(?s)^(.*?)\s+[-–—:]\s+(.*)$"


def _any(c: Column, patterns: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for p in patterns:
        found = found | c.rlike(sql_pattern(p))
    return found


def _all(c: Column, patterns: tuple[str, ...]) -> Column:
    found = F.lit(True)
    for p in patterns:
        found = found & c.rlike(sql_pattern(p))
    return found


def title_key(c: Column) -> Column:
    """Collapsed, lower case, without an item number in front and marks at the ends."""
    return F.btrim(F.regexp_replace(lower(collapse(F.coalesce(c, F.lit("")))), r"^\s*(?:item\s*)?#?\s*\d+(?:\.\d+)?[\.\):]\s*", ""), F.lit(" -:\t"))


def is_procedural(c: Column) -> Column:
    # one pattern, so that the key is worked out once; the last of the whole titles is the empty one
    return title_key(c).rlike(sql_pattern("|".join(("^(?:" + "|".join((*PROCEDURAL_TITLES, "")) + ")$", *PROCEDURAL_PATTERNS))))


def is_contact(title: Column, description: Column | None = None) -> Column:
    """Contact lines and letterheads."""
    pattern = sql_pattern("|".join(CONTACT_PATTERNS))

    def rule(own: Column) -> Column:
        both = own if description is None else F.btrim(F.concat_ws(" ", own, lower(collapse(F.coalesce(description, F.lit(""))))), F.lit(SPACES))
        return both.rlike(pattern) | own.rlike(r"^(from:|to:|cc:)")

    return once(lower(collapse(F.coalesce(title, F.lit("")))), rule)


def portal_items(items: DataFrame, title: str = "title") -> DataFrame:
    """Rows of a portal that may be agenda items, titles collapsed: subject lines always, and what is no procedure, section, notice or overlong text."""
    t = collapse(F.coalesce(F.col(title), F.lit("")))

    def fit(low: Column) -> Column:
        long = (F.length(low) >= 180) & ~(low.contains("public hearing") | low.contains("subject:") | low.contains("application no"))
        dropped = _any(low, PORTAL_PROCEDURE) | low.isin(*PORTAL_SECTIONS) | low.rlike(sql_pattern("|".join(PORTAL_NOTICES))) | long
        return (low != "") & (low.startswith("subject:") | ~dropped)

    return items.withColumn(title, t).filter(once(lower(F.col(title)), fit))


def portal_acceptance(items: DataFrame, key: str, title: str = "title") -> DataFrame:
    """key, items, substantive, accepted: three items at least, and three that are neither procedure nor contact."""
    n = portal_items(items, title).groupBy(key).agg(F.count("*").alias("items"), F.count_if(~is_procedural(F.col(title)) & ~is_contact(F.col(title))).alias("substantive"))
    return n.withColumn("accepted", (F.col("items") >= 3) & (F.col("substantive") >= 3))


def is_staff_report(text: Column) -> Column:
    """A report on one item: its memo head, no line of procedure, few numbered headings."""
    low = F.lower(text)
    strong = sum((text.rlike(ascii_bounds(p)).cast("int") for p in REPORT_STRONG), F.lit(0))
    support = sum((low.contains(p).cast("int") for p in REPORT_SUPPORT), F.lit(0))
    procedure = sum((F.regexp_count(text, F.lit(p)) for p in AGENDA_LINES), F.lit(0))
    headings = F.regexp_count(text, F.lit(AGENDA_HEADING))
    template = low.contains("{{ section") | low.contains("{{ item.tracking")
    named = low.contains("agenda report") | low.contains("administrative report")
    return named & (strong >= 4) & (procedure == 0) & ~((headings >= 20) & (support < 2) & ~template) & ((support >= 1) | low.contains("administrative report"))


def bad_content(text: Column, location: Column | None = None, url: Column | None = None, category: Column | None = None, structured: Column | None = None) -> Column:
    """Why a text is no document, or null. Portal texts count where location and url (if either is given) are the portal's; a staff report only in an agenda (category given) without a better source."""
    value = F.coalesce(text, F.lit(""))
    portal = F.when(_all(value, ERROR_PAGE), "laserfiche_error_page_detected").when(_all(value, LOADING_SHELL), "laserfiche_loading_shell_detected")
    if location is not None or url is not None:
        place, link = (F.lower(F.trim(F.coalesce(c if c is not None else F.lit(""), F.lit("")))) for c in (location, url))
        there = place.rlike(r"\.html?$") & link.contains("portal.laserfiche.com/portal/") & link.rlike(r"docview\.aspx|electronicfile\.aspx")
        portal = F.when(there, portal)
    if category is None:
        return portal
    better = F.lit(False) if structured is None else F.coalesce(structured, F.lit(False))
    report = (F.lower(F.trim(F.coalesce(category, F.lit("")))) == "agenda") & ~better & is_staff_report(value)
    return F.coalesce(portal, F.when(report, "single_item_staff_report_detected"))


def compliance(summary: Column) -> Column:
    """struct(sections, fallback, partial): required sections are there, a fallback's phrase is, partial coverage is told."""
    low = F.lower(F.coalesce(summary, F.lit("")))
    sections, fallback = F.lit(True), F.lit(False)
    for s in SECTIONS:
        sections = sections & low.contains(s)
    for s in FALLBACKS:
        fallback = fallback | low.contains(s)
    return F.struct(sections.alias("sections"), fallback.alias("fallback"), _any(low, PARTIAL).alias("partial"))


def claims(summaries: DataFrame, key: str, summary: str) -> DataFrame:
    """key, claim_no, claim: the lines of a summary that claim something, without bullets; the bluf line if no other does."""
    line = collapse(F.col("line"))
    d = summaries.select(key, F.posexplode(F.split(F.coalesce(summary, F.lit("")), "\n")).alias("claim_no", "line")).withColumn("line", line)
    d = d.withColumn("claim", F.trim(F.regexp_replace(F.trim(F.regexp_replace("line", r"^[*•-]+\s*", "")), r"^[^A-Za-z0-9]+", "")))
    low = F.lower("claim")
    few = F.regexp_count(low, F.lit(r"[a-z0-9']+")) <= 6
    none = (F.length("claim") < 5) | low.startswith("bluf:") | low.isin(*HEADERS) | (low.endswith(":") & few) | (low.startswith("here") & low.contains("summary")) | low.contains("executive summary") | (low.contains("summary") & low.endswith(":")) | low.startswith("summary of the meeting")
    plain = d.filter(~none).select(key, "claim_no", "claim")
    bluf = d.filter(F.lower("line").startswith("bluf:")).groupBy(key).agg(F.min_by(F.trim(F.substr("line", F.lit(6))), "claim_no").alias("claim"), F.min("claim_no").alias("claim_no")).filter(F.length("claim") >= 5)
    return plain.unionByName(bluf.join(plain.select(key).distinct(), key, "left_anti").select(key, "claim_no", "claim"))


def grounding(summaries: DataFrame, key: str, summary: str, source: str) -> DataFrame:
    """key, claims, unsupported, coverage, grounded: which share of each claim's words (three characters or more, no stop words) the source has, whole or by a prefix of five."""
    c = claims(summaries, key, summary)
    words = F.regexp_extract_all(F.lower(F.coalesce(source, F.lit(""))), F.lit(r"([a-z0-9']+)"), 1)
    s = summaries.select(key, F.explode(F.array_distinct(words)).alias("token"))
    p = s.filter(F.length("token") >= 5).select(key, F.substring("token", 1, 5).alias("prefix")).distinct()
    w = c.select(key, "claim_no", F.explode(F.regexp_extract_all(F.lower("claim"), F.lit(r"([a-z0-9']+)"), 1)).alias("token")).filter((F.length("token") >= 3) & ~F.col("token").isin(*CLAIM_STOP_WORDS))
    w = w.groupBy(key, "claim_no", "token").agg(F.count("*").alias("n")).withColumn("prefix", F.when(F.length("token") >= 5, F.substring("token", 1, 5)))
    w = w.join(s.withColumn("whole", F.lit(True)), [key, "token"], "left").join(p.withColumn("begins", F.lit(True)), [key, "prefix"], "left")
    share = w.groupBy(key, "claim_no").agg((F.sum(F.when(F.col("whole") | F.col("begins"), F.col("n")).otherwise(0)) / F.sum("n")).alias("share"))
    each = c.join(share, [key, "claim_no"], "left").withColumn("share", F.coalesce("share", F.lit(1.0)))
    has = s.select(key).distinct().withColumn("has", F.lit(True))
    each = each.join(has, key, "left").withColumn("share", F.when(F.col("has"), F.col("share")).otherwise(0.0))
    g = each.groupBy(key).agg(F.count("*").alias("claims"), F.count_if((F.col("share") < LEAST_COVERAGE) | F.col("has").isNull()).alias("unsupported"), F.round(F.avg("share"), 6).alias("coverage"))
    out = summaries.select(key).join(g, key, "left")
    return out.select(key, F.coalesce("claims", F.lit(0)).alias("claims"), F.coalesce("unsupported", F.lit(1)).alias("unsupported"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.coalesce(F.col("unsupported") == 0, F.lit(False)).alias("grounded"))


def model_items(answers: DataFrame, key: str, answer: str) -> DataFrame:
    """key, item_order, title, page_number, description: items of a model's answer; of the same number and title (in any case) the first."""
    d = answers.select(key, F.regexp_extract_all(answer, F.lit(ITEM_HEADER), 1).alias("numbers"), F.split(answer, ITEM_HEADER).alias("bodies"))
    d = d.select(key, F.posexplode(F.arrays_zip("numbers", F.slice("bodies", F.lit(2), F.greatest(F.size("numbers"), F.lit(1))).alias("body"))).alias("at", "x"))
    d = d.select(key, "at", F.col("x.numbers").try_cast("long").alias("item_order"), F.trim(F.regexp_replace("x.body", r"^\s+|\s+$", "")).alias("body")).filter("body <> '' AND item_order IS NOT NULL")
    page, dash = F.col("body").rlike(ITEM_PAGE), F.col("body").rlike(ITEM_DASH)
    part = lambda p, k: F.regexp_extract("body", p, k)
    title = F.when(page, part(ITEM_PAGE, 1)).when(dash, part(ITEM_DASH, 1)).otherwise(F.split_part("body", F.lit("\n"), F.lit(1)))
    rest = F.when(page, part(ITEM_PAGE, 3)).when(dash, part(ITEM_DASH, 2)).otherwise(F.regexp_replace("body", r"^[^\n]*\n?", ""))
    d = d.select(key, "at", "item_order", collapse(title).alias("title"), F.when(page, part(ITEM_PAGE, 2).try_cast("long")).otherwise(F.lit(1)).cast("long").alias("page_number"), collapse(F.regexp_replace(F.regexp_replace(rest, r"^\s+", ""), r"^[-–—:]\s*", "")).alias("description")).filter("title <> ''")
    first = Window.partitionBy(key, "item_order", F.lower("title")).orderBy("at")
    return d.withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n", "at")


def replaced_items(items: DataFrame, new: DataFrame, processed: DataFrame, longest: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(items, statuses) after the catalogs of processed (catalog_id, reason: why their text is bad, or null) get the rows of new (catalog_id, item_order, title) in place of their own; blank titles are left out."""
    good = processed.filter("reason IS NULL").select("catalog_id")
    rows = new.join(good, "catalog_id", "left_semi").withColumn("title", F.substring(collapse(F.col("title")), 1, longest)).filter("title <> ''")
    kept = items.join(good, "catalog_id", "left_anti").select("catalog_id", "item_order", "title").unionByName(rows.select("catalog_id", "item_order", "title"))
    n = rows.groupBy("catalog_id").agg(F.count("*").alias("n"))
    status = processed.join(n, "catalog_id", "left").select("catalog_id", F.when(F.col("reason").isNotNull(), "failed").when(F.col("n") > 0, "complete").otherwise("empty").alias("status"), F.when(F.col("reason").isNull(), F.coalesce("n", F.lit(0))).alias("items"), F.col("reason").alias("error"))
    return kept, status


def small_corpus_keywords(docs: DataFrame, stop: tuple[str, ...], key: str = "doc_id", text: str = "text", most: int = 5) -> DataFrame:
    """key, phrase, rank: a document's commonest phrases of two or three words (three letters or more), then its words, ties by text."""

    def words(x: Column) -> Column:
        return F.filter(F.regexp_extract_all(F.lower(x), F.lit(r"([a-z][a-z'-]{2,})"), 1), lambda w: ~w.isin(*stop))

    def phrases(w: Column) -> Column:
        gram = lambda n: F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(0))), lambda x, i: F.concat_ws(" ", x, *[F.get(w, i + j) for j in range(1, n)]))
        return F.concat(gram(2), gram(3))

    ordered = lambda k, c: F.transform(c, lambda x: F.struct(F.lit(k).alias("k"), (-x.n).alias("less"), x.value.alias("phrase")))
    d = texts_of(docs, key, text).select(key, F.transform("texts", words).alias("w"))
    d = d.select(key, counted(F.flatten(F.transform("w", phrases))).alias("phrases"), counted(F.flatten("w")).alias("words"))
    best = F.slice(F.sort_array(F.concat(ordered(0, F.col("phrases")), ordered(1, F.col("words")))), 1, most)
    return d.select(key, F.posexplode(best).alias("at", "x")).select(key, "x.phrase", (F.col("at") + 1).alias("rank"))
