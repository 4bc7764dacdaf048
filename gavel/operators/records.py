"""Catalog state, coverage, backlogs, and table changes as new snapshots."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavel.functions import text as X

#: What can be reported.
ISSUE_TYPES = ("broken_link", "garbled_text", "wrong_city", "other")
DERIVED = ("content", "summary", "summary_extractive", "topics", "entities", "related_ids", "tables", "content_hash", "agenda_items_hash", "agenda_segmentation_status", "agenda_segmentation_attempted_at", "agenda_segmentation_item_count", "agenda_segmentation_error", "entities_source_hash", "summary_source_hash", "topics_source_hash")


def first_document_kind(document: DataFrame) -> DataFrame:
    """catalog_id, document_id, kind of each catalog's first document."""
    first = document.groupBy("catalog_id").agg(F.min("id").alias("document_id"), F.min_by("category", "id").alias("category"))
    return first.select("catalog_id", "document_id", X.document_kind(F.col("category")).alias("kind"))


def item_hashes(items: DataFrame) -> DataFrame:
    """catalog_id, items, agenda_items_hash: a fingerprint of the items in order, over collapsed fields."""
    row = F.concat_ws("\x1f", F.col("item_order").cast("string"), X.collapse(F.coalesce("title", F.lit(""))), F.coalesce(F.col("page_number").cast("string"), F.lit("")))
    return items.groupBy("catalog_id").agg(F.count("*").alias("items"), F.sha2(F.concat_ws("\x1e", F.transform(F.array_sort(F.collect_list(F.struct("item_order", row.alias("row")))), lambda x: x["row"])), 256).alias("agenda_items_hash"))


def derived_status(catalog: DataFrame, document: DataFrame, items: DataFrame) -> DataFrame:
    """For each catalog: kind, number of items, the state of its summary by the hash it was made from, by the simpler rule of the content hash alone, and whether its text can be summarised or tagged."""
    q = X.source_quality(F.col("content"))
    d = catalog.join(first_document_kind(document).select(F.col("catalog_id").alias("id"), "kind"), "id", "left").join(item_hashes(items).withColumnRenamed("catalog_id", "id"), "id", "left")
    expected = X.expected_source_hash(F.col("kind"), F.col("content_hash"), F.col("agenda_items_hash"), F.col("agenda_segmentation_status"))
    return d.withColumn("q", q).select(
        F.col("id").alias("catalog_id"),
        F.coalesce("kind", F.lit("unknown")).alias("kind"),
        F.coalesce("items", F.lit(0)).alias("items"),
        X.summary_state(F.col("summary"), F.col("summary_source_hash"), expected).alias("summary_state"),
        X.summary_state(F.col("summary"), F.col("summary_source_hash"), F.col("content_hash")).alias("simple_state"),
        X.is_summarizable(F.col("q")).alias("summarizable"),
        X.is_topicable(F.col("q")).alias("topicable"),
    )


def backlog(catalog: DataFrame, document: DataFrame, resume_after: int = 0, limit: int = 100) -> DataFrame:
    """Ids of catalogs with content but no summary, or one that is stale by content, that some document links, in order from where the last batch ended."""
    open_ = catalog.filter((F.coalesce("content", F.lit("")) != "") & (X.summary_state(F.col("summary"), F.col("summary_source_hash"), F.col("content_hash")) != "fresh"))
    linked = open_.join(document.select(F.col("catalog_id").alias("id")), "id", "left_semi")
    return linked.filter(F.col("id") > resume_after).select("id").distinct().orderBy("id").limit(limit)


def sibling_priority(document: DataFrame) -> DataFrame:
    """catalog_id, priority: 0 for agendas whose event has an HTML agenda too, 1 for other agendas, 2 for the rest; the least over a catalog's documents."""
    html = document.filter("category = 'agenda_html'").select("event_id").distinct().withColumn("has_html", F.lit(True))
    d = document.join(html, "event_id", "left")
    rank = F.when((F.col("category") == "agenda") & F.col("has_html"), 0).when(F.col("category") == "agenda", 1).otherwise(2)
    return d.groupBy("catalog_id").agg(F.min(rank).alias("priority"))


def run_window_rows(runs: DataFrame, staged: DataFrame) -> DataFrame:
    """Distinct (city, url_hash) staged while a run of that city was on; runs: city, started, finished."""
    r = runs.select("city", "started", "finished")
    return staged.join(r, "city").filter(F.col("created_at").between(F.col("started"), F.col("finished"))).select("city", "url_hash").distinct()


def touched_hashes(history: DataFrame, stage: DataFrame) -> DataFrame:
    """Distinct hashes of two tables."""
    return history.select("url_hash").union(stage.select("url_hash")).distinct()


def place_counts(place: DataFrame, event: DataFrame, document: DataFrame, organization: DataFrame) -> DataFrame:
    """place, events, documents, catalogs, organizations: each counted before it is joined."""
    e = event.groupBy("place_id").agg(F.count("*").alias("events"))
    d = document.join(event.select(F.col("id").alias("event_id"), "place_id"), "event_id").groupBy("place_id").agg(F.count("*").alias("documents"), F.countDistinct("catalog_id").alias("catalogs"))
    o = organization.groupBy("place_id").agg(F.count("*").alias("organizations"))
    p = place.select(F.col("id").alias("place_id"), F.col("name").alias("place"))
    return p.join(e, "place_id", "left").join(d, "place_id", "left").join(o, "place_id", "left").fillna(0).drop("place_id")


def freshness(catalog: DataFrame, event: DataFrame, today: dt.date) -> DataFrame:
    """One row: catalogs, processed, summarized, events, the latest date, and whether it is over a week before today."""
    c = catalog.agg(F.count("*").alias("catalogs"), F.count_if(F.coalesce("content", F.lit("")) != "").alias("processed"), F.count_if(F.coalesce("summary", F.lit("")) != "").alias("summarized"))
    e = event.agg(F.count("*").alias("events"), F.max("record_date").alias("latest"))
    return c.crossJoin(e).withColumn("stale", F.datediff(F.lit(today), "latest") > 7)  # one row each


def coverage_audit(event: DataFrame, document: DataFrame, catalog: DataFrame, city: str, as_of: dt.date, months: int = 12) -> DataFrame:
    """A row for each of the last months, zeros included: events, meetings, agenda documents and catalogs, those with content and summary, and flags against half the median."""
    first = F.add_months(F.trunc(F.lit(as_of), "month"), 1 - months)
    calendar = event.sparkSession.range(months).select(F.add_months(first, F.col("id").cast("int")).alias("month"))
    e = event.filter((F.col("source") == city) & (F.col("record_date") >= first) & (F.col("record_date") <= F.lit(as_of))).withColumn("month", F.trunc("record_date", "month"))
    meetings = e.groupBy("month").agg(F.countDistinct("id").alias("events"), F.countDistinct("record_date", F.lower(X.collapse(F.col("name")))).alias("meetings"))
    agenda = e.select(F.col("id").alias("event_id"), "month").join(document.filter(X.document_kind(F.col("category")) == "agenda"), "event_id")
    agenda = agenda.join(catalog.select(F.col("id").alias("catalog_id"), (F.coalesce("content", F.lit("")) != "").alias("has"), (F.coalesce("summary", F.lit("")) != "").alias("summed")), "catalog_id")
    docs = agenda.groupBy("month").agg(F.count("*").alias("agenda_documents"), F.countDistinct("catalog_id").alias("agenda_catalogs"), F.countDistinct(F.when(F.col("has"), F.col("catalog_id"))).alias("with_content"), F.countDistinct(F.when(F.col("summed"), F.col("catalog_id"))).alias("with_summary"))
    d = calendar.join(meetings, "month", "left").join(docs, "month", "left").fillna(0)
    d = d.withColumn("median_meetings", F.median("meetings").over(Window.partitionBy(F.lit(1))))
    threshold = F.when(F.col("median_meetings") >= 2, F.ceil(F.col("median_meetings") * 0.5))
    flags = F.array_compact(
        F.array(
            F.when(F.col("meetings") == 0, "no_meetings"),
            F.when((F.col("meetings") < threshold) & (F.col("month") < F.trunc(F.lit(as_of), "month")), "low_cadence"),
            F.when((F.col("meetings") > 0) & (F.col("agenda_documents") == 0), "no_agendas"),
            F.when((F.col("agenda_catalogs") > 0) & (F.col("with_content") < F.col("agenda_catalogs")), "missing_content"),
            F.when((F.col("with_content") > 0) & (F.col("with_summary") < F.col("with_content")), "missing_summaries"),
        )
    )
    return d.withColumn("flags", F.concat_ws(",", flags))


def crawl_evidence(stage: DataFrame, division: str, start: dt.datetime, end: dt.datetime, at: str = "created_at") -> DataFrame:
    """One row, n: staged rows of a division in [start, end + 1 s)."""
    return stage.filter((F.col("ocd_division_id") == division) & (F.col(at) >= F.lit(start)) & (F.col(at) < F.lit(end + dt.timedelta(seconds=1)))).agg(F.count("*").alias("n"))


def verification_baseline(event: DataFrame) -> DataFrame:
    """source, latest, n of each source's events."""
    return event.groupBy("source").agg(F.max("record_date").alias("latest"), F.count("*").alias("n"))


def validated(rows: DataFrame) -> DataFrame:
    """rows with reasons: what a crawled row lacks; empty for good ones. Bad rows can be written to quarantine instead of being dropped."""
    reasons = F.array_compact(F.array(F.when(F.coalesce("name", F.lit("")) == "", "name"), F.when(F.col("record_date").isNull(), "record_date"), F.when(~F.coalesce(F.col("ocd_division_id").startswith("ocd-"), F.lit(False)), "ocd_division_id")))
    return rows.withColumn("reasons", F.concat_ws(",", reasons))


def promote(stage: DataFrame, event: DataFrame, place: DataFrame) -> DataFrame:
    """stage with outcome: blocked (unknown place), duplicate (of an event, or of an earlier row of the batch, null dates equal), or promoted."""
    s = stage.join(place.select("ocd_division_id", F.col("id").alias("place_id")), "ocd_division_id", "left")
    known = event.select(F.col("place_id").alias("_p"), F.col("record_date").alias("_d"), F.col("name").alias("_n")).distinct().withColumn("_known", F.lit(True))
    s = s.join(known, (F.col("place_id") == F.col("_p")) & F.col("record_date").eqNullSafe(F.col("_d")) & (F.col("name") == F.col("_n")), "left")
    s = s.withColumn("_nth", F.row_number().over(Window.partitionBy("place_id", "record_date", "name").orderBy("id")))
    outcome = F.when(F.col("place_id").isNull(), "blocked").when(F.col("_known") | (F.col("_nth") > 1), "duplicate").otherwise("promoted")
    return s.withColumn("outcome", outcome).select(*stage.columns, "place_id", "outcome")


def upsert_places(place: DataFrame, seeds: DataFrame) -> DataFrame:
    """place with seeds merged in by division: new ones inserted, name and state of known ones replaced; change tells which. seeds: ocd_division_id, name, state, hosting, url."""
    host = F.parse_url(F.col("url"), F.lit("HOST"))
    s = seeds.select("ocd_division_id", F.col("name").alias("_name"), F.col("state").alias("_state"), F.when(F.lower("hosting").contains("legistar") & host.endswith(".legistar.com"), F.substring_index(host, ".", 1)).alias("client"), F.lit(True).alias("_seed"))
    d = place.withColumn("_old", F.lit(True)).join(s, "ocd_division_id", "full")
    change = F.when(F.col("_old").isNull(), "insert").when(F.col("_seed").isNull(), "keep").when(F.col("name").eqNullSafe(F.col("_name")) & F.col("state").eqNullSafe(F.col("_state")), "same").otherwise("update")
    return d.select("ocd_division_id", F.coalesce("_name", "name").alias("name"), F.coalesce("_state", "state").alias("state"), "client", change.alias("change"))


def backfill_organizations(event: DataFrame, organization: DataFrame) -> DataFrame:
    """event with body and body_id: Planning, Parks or Council by meeting type, the least id of such a body in the place, null where it has yet to be made, and changed."""
    low = F.lower(F.coalesce("meeting_type", F.lit("")))
    body = F.when(low.contains("planning commission") | low.contains("planning board"), "Planning Commission").when(low.contains("parks"), "Parks Commission").otherwise("City Council")
    target = organization.groupBy("place_id", F.col("name").alias("body")).agg(F.min("id").alias("body_id"))
    return event.withColumn("body", body).join(target, ["place_id", "body"], "left").withColumn("changed", ~F.col("organization_id").eqNullSafe(F.col("body_id")))


def upsert_embeddings(stored: DataFrame, incoming: DataFrame, model: str) -> DataFrame:
    """catalog_id, status: inserted, updated (other source hash), cached (same) or kept (not in the batch), for a model."""
    s = stored.filter(F.col("model_name") == model).select("catalog_id", F.col("source_hash").alias("_old"))
    d = s.join(incoming.select("catalog_id", F.col("source_hash").alias("_new"), F.lit(True).alias("_in")), "catalog_id", "full")
    return d.select("catalog_id", F.when(F.col("_in").isNull(), "kept").when(F.col("_old").isNull(), "inserted").when(F.col("_old") == F.col("_new"), "cached").otherwise("updated").alias("status"))


def purge_derived(catalog: DataFrame) -> DataFrame:
    """catalog with every derived column null."""
    return catalog.withColumns({c: F.lit(None).cast(catalog.schema[c].dataType) for c in DERIVED if c in catalog.columns})


def backfill_hashes(catalog: DataFrame) -> DataFrame:
    """catalog with missing content hashes filled in."""
    return catalog.withColumn("content_hash", F.coalesce("content_hash", X.content_hash(F.col("content"))))


def report_issues(issues: DataFrame, event: DataFrame) -> DataFrame:
    """issues with reason: null where the event is known, the type is one of four and the description has at most 500 characters."""
    d = issues.join(event.select(F.col("id").alias("event_id")).distinct().withColumn("_known", F.lit(True)), "event_id", "left")
    reason = F.when(F.col("_known").isNull(), "unknown_event").when(~F.col("issue_type").isin(*ISSUE_TYPES), "issue_type").when(F.length("description") > 500, "description")
    return d.withColumn("reason", reason).drop("_known")


def extraction_state(ok: Column, attempts: Column, error: Column, terminal: int = 3) -> dict[str, Column]:
    """Columns after an attempt: success starts afresh; a failure counts, is final at the third, and keeps 500 characters of its error."""
    n = F.when(ok, 0).otherwise(F.coalesce(attempts, F.lit(0)) + 1)
    return {"attempts": n, "state": F.when(ok, "complete").when(n >= terminal, "failed_terminal").otherwise("failed"), "error": F.when(~ok, F.substring(error, 1, 500))}


def character_budget(items: DataFrame, budget: int, key: str = "catalog_id", order: str = "item_order", text: str = "title") -> DataFrame:
    """Items before the first one at which a catalog's running characters pass the budget."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return items.withColumn("running_chars", F.sum(F.length(F.coalesce(text, F.lit("")))).over(w)).filter(F.col("running_chars") <= budget)
