"""Changes of tables, batch by batch: promotion of events, upserts of embeddings, replaced agenda items, the search-document sink.

Each works on a versioned table (gavel.plans.tables.Versioned): a batch is applied once, and a reader sees the table before it or after it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavel.functions import text as X
from gavel.operators import records, titles
from gavel.plans.tables import Versioned

#: A corpus' fingerprint is taken over so many blocks of catalogs.
BLOCKS = 4096


def upserted(table: DataFrame | None, rows: DataFrame, key: str) -> DataFrame:
    """table with rows in place of those of the same key; of rows that repeat a key the table gets all."""
    if table is None:
        return rows
    return table.join(rows.select(key), key, "left_anti").unionByName(rows.select(*table.columns))


def promote_events(events: Versioned, stage: DataFrame, place: DataFrame, batch: str) -> bool:
    """Add the staged rows (id, ocd_division_id, record_date, name) that are new events of known places; their ids follow the table's greatest. False if the batch was applied before."""

    def change(table: DataFrame) -> DataFrame:
        last = table.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"))  # one row
        new = records.promote(stage, table, place).filter("outcome = 'promoted'").crossJoin(F.broadcast(last)).withColumn("id", F.col("_last") + F.col("id"))
        missing = [F.lit(None).cast(table.schema[c].dataType).alias(c) for c in table.columns if c not in new.columns]
        return table.unionByName(new.select("*", *missing).select(*table.columns))

    return events.apply(batch, change)


def embedding_statuses(stored: DataFrame | None, catalogs: DataFrame, model: str, force: bool = False) -> DataFrame:
    """catalog_id, source_hash, status of catalogs (catalog_id, summary): skipped (the summary is too short), cached (same hash stored for the model), inserted or updated."""
    c = catalogs.select("catalog_id", X.semantic_hash(F.col("summary")).alias("source_hash"))
    if stored is None:
        return c.withColumn("status", F.when(F.col("source_hash").isNull(), "skipped").otherwise("inserted"))
    known = stored.filter(F.col("model_name") == model).select("catalog_id", F.col("source_hash").alias("_old"), F.lit(True).alias("_known"))
    d = c.join(known, "catalog_id", "left")
    status = F.when(F.col("source_hash").isNull(), "skipped").when(F.col("_known").isNull(), "inserted").when((F.col("_old") == F.col("source_hash")) & F.lit(not force), "cached").otherwise("updated")
    return d.select("catalog_id", "source_hash", status.alias("status"))


def upsert_embeddings(store: Versioned, catalogs: DataFrame, vectors: DataFrame, model: str, batch: str, force: bool = False) -> bool:
    """Store the vectors (catalog_id, embedding) of catalogs whose summary's hash is new, for a model; rows of other models and catalogs stay. False if the batch was applied before."""

    def change(table: DataFrame | None) -> DataFrame:
        wanted = embedding_statuses(table, catalogs, model, force).filter("status IN ('inserted', 'updated')").select("catalog_id", "source_hash")
        rows = wanted.join(vectors.select("catalog_id", "embedding"), "catalog_id").select("catalog_id", F.lit(model).alias("model_name"), F.size("embedding").alias("embedding_dim"), "source_hash", "embedding")
        if table is None:
            return rows
        own = table.filter(F.col("model_name") == model).join(rows.select("catalog_id"), "catalog_id", "left_anti")
        return table.filter(F.col("model_name") != model).unionByName(own.select(*table.columns)).unionByName(rows)

    return store.apply(batch, change)


def corpus_hash(table: DataFrame, model: str) -> DataFrame:
    """One row, corpus_hash: a fingerprint of a model's catalogs and source hashes, over the fingerprints of blocks of catalogs, so that no task holds them all."""
    row = F.concat_ws(":", F.col("catalog_id").cast("string"), "source_hash")
    blocks = table.filter(F.col("model_name") == model).groupBy(F.pmod("catalog_id", F.lit(BLOCKS)).alias("block")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("catalog_id", row.alias("row")))), lambda x: x["row"]), ","), 256).alias("h"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("block", "h"))), lambda x: F.concat_ws(":", x["block"].cast("string"), x["h"]))  # BLOCKS rows at most
    return blocks.agg(F.sha2(F.array_join(listed, ","), 256).alias("corpus_hash"))


def replace_items(items: Versioned, new: DataFrame, processed: DataFrame, batch: str) -> bool:
    """Put the rows of new in place of the items of the catalogs that were processed well (see titles.replaced_items). False if the batch was applied before."""
    return items.apply(batch, lambda table: titles.replaced_items(table, new, processed)[0])


class _Appended(Versioned):
    """A table each of whose snapshots has only new rows, after the last snapshot of another one, if that has any."""

    def __init__(self, before: Versioned, folder: str):
        super().__init__(before.spark, folder)
        self.before = before

    def read(self, version: int | None = None) -> DataFrame | None:
        parts = [self.before.read()] if self.before.batches() else []
        parts += [super(_Appended, self).read(number) for number in range(len(self.batches()))]
        return reduce(DataFrame.unionByName, parts) if parts else None


def _texts(sink: Versioned) -> _Appended:
    """A sink's contents (_content, content); sinks written before have theirs in _texts, whose last snapshot has all."""
    return _Appended(Versioned(sink.spark, f"{sink.folder}/_texts"), f"{sink.folder}/_contents")


def write_search_documents(sink: Versioned, documents: DataFrame, batch: str, gone: DataFrame | None = None, contents: DataFrame | None = None) -> bool:
    """Put documents in place of those of the same id, drop those of gone (id); written by result_type. False if the batch was applied before.

    Many documents share a catalog's content, so contents are kept once each, by their hash, beside the rows: a batch moves and rewrites no
    content for each document, and none that is kept already. They are written first, so a snapshot's contents are always there; those that no row names any more stay.
    documents have content, or _content, its SHA-256, with the texts they name in contents (_content, content).
    """
    if contents is None and "content" in documents.columns:
        key = F.sha2("content", 256).alias("_content")
        contents = documents.select(key, "content")
        documents = documents.select(*[key if c == "content" else c for c in documents.columns])

    def change(table: DataFrame | None) -> DataFrame:
        ids = gone.select("id") if gone is not None else None
        rows = documents.join(ids, "id", "left_anti") if gone is not None else documents
        if table is None:
            return rows
        # rows that go are left out before the others are added, so a table's rows are shuffled once
        out = documents.select("id").unionByName(ids) if gone is not None else documents.select("id")
        return table.join(out, "id", "left_anti").unionByName(rows.select(*table.columns))

    if batch in sink.batches():
        return False
    if contents is not None:
        store, new = _texts(sink), contents.filter("_content IS NOT NULL")
        kept = store.read()
        if kept is not None:
            # mostly all are kept already, and then no text is moved to see it
            keys = new.select("_content").join(kept.select("_content"), "_content", "left_anti").distinct()
            new = new.limit(0) if keys.isEmpty() else new.join(keys, "_content", "left_semi")
        store.apply(batch, lambda _: new.dropDuplicates(["_content"]))
    return sink.apply(batch, change, partition_by=("result_type",))


def search_documents(sink: Versioned, value=lambda content: content) -> DataFrame:
    """The documents of a sink with their contents; value: what is made of a content, once for all its documents."""
    rows = sink.read()
    columns = ["content" if c == "_content" else c for c in rows.columns]
    texts = _texts(sink).read().select("_content", value(F.col("content")).alias("content"))
    # rows without a content meet none: in a join they would all come to one task
    bare = rows.filter("_content IS NULL").withColumn("content", F.lit(None).cast(texts.schema["content"].dataType))
    return rows.filter("_content IS NOT NULL").join(texts, "_content", "left").select(*columns).unionByName(bare.select(*columns))
