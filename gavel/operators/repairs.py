"""Repair of links: catalogs whose file was found elsewhere get the new link and lose what was derived from the old file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Columns of a catalog that a new file makes void, and those that begin anew.
VOID = ("content", "content_hash", "extraction_attempted_at", "extraction_error", "summary", "summary_source_hash", "summary_extractive", "entities", "topics", "topics_source_hash", "agenda_segmentation_status", "agenda_segmentation_attempted_at", "agenda_segmentation_item_count", "agenda_segmentation_error")
ANEW = {"extraction_status": "pending", "extraction_attempt_count": 0}


def repair_verdicts(catalog: DataFrame, repairs: DataFrame) -> DataFrame:
    """repairs with outcome: updated, skipped_duplicate_hash (another catalog has the new hash, or gets it by a repair before in seq), no_catalog.

    catalog: id, url_hash; repairs: seq (order), catalog_id, new_url, new_hash, path, filename. Hashes count as they were before all repairs, so one that a repair of the same batch gives up is still taken; of several repairs of a catalog only the first whose hash no other catalog had is looked at (there is one for each, as they are chosen). A hash that very many repairs ask for is reduced by partial aggregation, not gathered.
    """
    owners = catalog.filter("url_hash IS NOT NULL").groupBy(F.col("url_hash").alias("new_hash")).agg(F.min("id").alias("_least"), F.max("id").alias("_greatest"))
    # of all owners of a hash one is enough that is not the catalog itself
    d = repairs.join(owners, "new_hash", "left").join(catalog.select(F.col("id").alias("catalog_id"), F.lit(True).alias("_there")), "catalog_id", "left")
    d = d.withColumn("_taken", F.coalesce((F.col("_least") != F.col("catalog_id")) | (F.col("_greatest") != F.col("catalog_id")), F.lit(False)))
    able = F.col("_there") & ~F.col("_taken")
    own = d.filter(able).groupBy("catalog_id").agg(F.min("seq").alias("_own"))
    d = d.join(own, "catalog_id", "left")
    first = d.filter(able & (F.col("seq") == F.col("_own"))).groupBy("new_hash").agg(F.min_by("catalog_id", "seq").alias("_winner"))
    d = d.join(first, "new_hash", "left")
    taken = F.col("_taken") | F.coalesce((F.col("_winner") != F.col("catalog_id")), F.lit(False)) | (F.col("seq") != F.col("_own"))
    outcome = F.when(F.col("_there").isNull() & ~F.col("_taken"), "no_catalog").when(taken, "skipped_duplicate_hash").otherwise("updated")
    return d.select(*repairs.columns, outcome.alias("outcome"))


def apply_repairs(catalog: DataFrame, documents: DataFrame, embeddings: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables after the repairs that repair_verdicts lets pass: catalogs with the new link and file and nothing derived, their agenda documents with the new link, and no embeddings of theirs."""
    made = verdicts.filter("outcome = 'updated'").select(F.col("catalog_id").alias("_id"), "new_url", "new_hash", "path", "filename")
    renamed = made.toDF("_id", "_url", "_hash", "_path", "_filename")
    hit = F.col("_id").isNotNull()
    fresh = {"url": F.col("_url"), "url_hash": F.col("_hash"), "location": F.col("_path"), "filename": F.col("_filename"), **{c: F.lit(None) for c in VOID}, **{c: F.lit(v) for c, v in ANEW.items()}}
    after = lambda table, key, values, also: table.join(renamed, F.col(key) == F.col("_id"), "left").select(*(F.when(hit & also, values[c].cast(table.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in table.columns))
    agendas = after(documents, "catalog_id", {c: fresh[c] for c in ("url", "url_hash")}, F.col("category").eqNullSafe(F.lit("agenda")))
    return after(catalog, "id", fresh, F.lit(True)), agendas, embeddings.join(renamed, F.col("catalog_id") == F.col("_id"), "left_anti")
