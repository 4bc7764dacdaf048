"""People: roster authorisation, history, reconciliation; staged links; embeddings' freshness; onboarding."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def authorized_people(person: DataFrame, membership: DataFrame, place: DataFrame, bodies: DataFrame) -> DataFrame:
    """People with a membership of the same client, with evidence, in an authorised body (slug of the place, name of the body, case aside)."""
    allowed = bodies.select(F.col("slug").alias("_slug"), F.lower("body").alias("_body")).distinct()
    p = place.select(F.col("id").alias("place_id"), F.element_at(F.split("ocd_division_id", "/place:"), -1).alias("_slug"))
    m = membership.filter(F.col("evidence").isNotNull()).join(p, "place_id").withColumn("_body", F.lower("body")).join(allowed, ["_slug", "_body"], "left_semi")
    return person.join(m.select(F.col("person_id").alias("id"), "client"), ["id", "client"], "left_semi")


def role_history(membership: DataFrame, place: DataFrame) -> DataFrame:
    """person_id, roles: memberships in order of their start, with body, city and label (Member where none is given)."""
    p = place.select(F.col("id").alias("place_id"), F.initcap(F.replace("name", F.lit("_"), F.lit(" "))).alias("city"))
    d = membership.join(p, "place_id")
    return d.groupBy("person_id").agg(F.concat_ws("; ", F.transform(F.array_sort(F.collect_list(F.struct("start", "body", "city", F.coalesce("label", F.lit("Member")).alias("label")))), lambda r: F.concat_ws("|", r["start"].cast("string"), r["body"], r["city"], r["label"]))).alias("roles"))


def reconcile_roster(stored: DataFrame, snapshot: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """keys and change (insert, update, delete or same) between what is stored and a snapshot."""
    a = stored.select(*keys, F.struct(*values).alias("_old"), F.lit(True).alias("_a"))
    b = snapshot.select(*keys, F.struct(*values).alias("_new"), F.lit(True).alias("_b"))
    d = a.join(b, keys, "full")
    return d.select(*keys, F.when(F.col("_a").isNull(), "insert").when(F.col("_b").isNull(), "delete").when(F.col("_old").eqNullSafe(F.col("_new")), "same").otherwise("update").alias("change"))


def link_staged_urls(staged: DataFrame, event: DataFrame, catalog: DataFrame, document: DataFrame) -> DataFrame:
    """id, outcome of staged files: no_event, known (its event has the file already), linked (a file that is known or came earlier in the batch) or new."""
    e = event.select(F.col("id").alias("event_id"), "ocd_division_id", F.col("record_date").alias("_d"), F.col("name").alias("_n")).groupBy("ocd_division_id", "_d", "_n").agg(F.min("event_id").alias("event_id"))
    s = staged.join(e, (staged["ocd_division_id"] == e["ocd_division_id"]) & F.col("record_date").eqNullSafe(F.col("_d")) & (F.col("name") == F.col("_n")), "left").select("id", "url_hash", "event_id")
    s = s.join(catalog.select("url_hash", F.col("id").alias("catalog_id")), "url_hash", "left")
    s = s.join(document.select("event_id", "catalog_id", F.lit(True).alias("_have")).distinct(), ["event_id", "catalog_id"], "left")
    nth = F.row_number().over(Window.partitionBy("url_hash", F.col("event_id").isNull()).orderBy("id"))
    again = F.row_number().over(Window.partitionBy("url_hash", "event_id").orderBy("id"))
    outcome = F.when(F.col("event_id").isNull(), "no_event").when(F.col("_have") | (again > 1), "known").when(F.col("catalog_id").isNotNull() | (nth > 1), "linked").otherwise("new")
    return s.select("id", outcome.alias("outcome"))


def embedding_freshness(catalog: DataFrame, embedding: DataFrame, model: str) -> DataFrame:
    """catalog_id, state: fresh, stale (made from another summary) or missing, for catalogs with a summary."""
    e = embedding.filter(F.col("model_name") == model).select("catalog_id", "source_hash")
    c = catalog.filter(F.coalesce("summary", F.lit("")) != "").select(F.col("id").alias("catalog_id"), F.sha2("summary", 256).alias("_expected"))
    return c.join(e, "catalog_id", "left").select("catalog_id", F.when(F.col("source_hash").isNull(), "missing").when(F.col("source_hash") == F.col("_expected"), "fresh").otherwise("stale").alias("state"))


def onboarding_counts(star: DataFrame) -> DataFrame:
    """city, catalogs, agendas, non_empty, segmented of each city's distinct catalogs."""
    agenda = F.col("kind") == "agenda"
    d = star.groupBy("city", "catalog_id").agg(F.max(agenda).alias("agenda"), F.max(F.coalesce("content", F.lit("")) != "").alias("full"), F.max(F.col("agenda_segmentation_status").isin("complete", "empty")).alias("segmented"))
    return d.groupBy("city").agg(F.count("*").alias("catalogs"), F.count_if("agenda").alias("agendas"), F.count_if("full").alias("non_empty"), F.count_if(F.col("agenda") & F.coalesce("segmented", F.lit(False))).alias("segmented"))


def onboarding_gate(counts: DataFrame, content: float = 0.9, segmentation: float = 0.95) -> DataFrame:
    """counts with rates, failed (names of the rates below their thresholds) and verdict: pass, fail or insufficient_data."""
    d = counts.withColumn("content_rate", F.round(F.try_divide("non_empty", "catalogs"), 6)).withColumn("segmentation_rate", F.round(F.try_divide("segmented", "agendas"), 6))
    failed = F.array_compact(F.array(F.when(F.col("content_rate") < content, "content"), F.when(F.col("segmentation_rate") < segmentation, "segmentation")))
    d = d.withColumn("failed", F.concat_ws(",", failed))
    return d.withColumn("verdict", F.when((F.col("catalogs") == 0) | (F.col("agendas") == 0), "insufficient_data").when(F.col("failed") == "", "pass").otherwise("fail"))
