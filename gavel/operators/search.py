"""Search documents, filters, facets, trends, ranking."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavel.functions import text as X

MAX_CONTENT = 50_000
ALIASES = {"san_mateo": ["san mateo"], "san_leandro": ["san leandro"], "mtn_view": ["mountain view"]}


@dataclass(frozen=True)
class SearchFilters:
    """What a search asks for; every part is optional."""

    city: str | None = None
    meeting_category: str | None = None
    organization: str | None = None
    date_from: dt.date | None = None
    date_to: dt.date | None = None
    include_agenda_items: bool = False

    def predicate(self) -> Column:
        """For stored documents: equality and an inclusive range of dates, which a scan can push down."""
        parts = [] if self.include_agenda_items else [F.col("result_type") == "meeting"]
        parts += [F.col(n) == v for n in ("city", "meeting_category", "organization") if (v := getattr(self, n)) is not None]
        parts += [F.col("date") >= F.lit(self.date_from)] * (self.date_from is not None) + [F.col("date") <= F.lit(self.date_to)] * (self.date_to is not None)
        return reduce(lambda a, b: a & b, parts, F.lit(True))

    def matcher(self) -> Column:
        """For candidates: the same without regard to case; a null date fails any bound."""
        parts = [] if self.include_agenda_items else [F.col("result_type") == "meeting"]
        parts += [F.lower(F.coalesce(F.col(n), F.lit(""))) == v.lower() for n in ("city", "meeting_category", "organization") if (v := getattr(self, n)) is not None]
        parts += [F.coalesce(F.col("date") >= F.lit(self.date_from), F.lit(False))] * (self.date_from is not None) + [F.coalesce(F.col("date") <= F.lit(self.date_to), F.lit(False))] * (self.date_to is not None)
        return reduce(lambda a, b: a & b, parts, F.lit(True))


def meeting_star(document: DataFrame, catalog: DataFrame, event: DataFrame, place: DataFrame, organization: DataFrame) -> DataFrame:
    """document with its catalog, event, place and, where there is one, organization."""
    e = event.select(F.col("id").alias("event_id"), "record_date", F.col("name").alias("event_name"), "meeting_type", "place_id", "organization_id")
    p = place.select(F.col("id").alias("place_id"), F.col("name").alias("city"))
    o = organization.select(F.col("id").alias("organization_id"), F.col("name").alias("organization"))
    c = catalog.withColumnRenamed("id", "catalog_id")
    return document.join(e, "event_id").join(p, "place_id").join(o, "organization_id", "left").join(c, "catalog_id")


def item_star(item: DataFrame, document: DataFrame, event: DataFrame, place: DataFrame, organization: DataFrame) -> DataFrame:
    """agenda items with the event of their catalog's first document, its place and organization."""
    first = document.groupBy("catalog_id").agg(F.min_by("event_id", "id").alias("event_id"))
    e = event.select(F.col("id").alias("event_id"), "record_date", "meeting_type", "place_id", "organization_id")
    p = place.select(F.col("id").alias("place_id"), F.col("name").alias("city"))
    o = organization.select(F.col("id").alias("organization_id"), F.col("name").alias("organization"))
    # items come last, so that titles are shuffled once
    return item.join(first.join(e, "event_id").join(p, "place_id").join(o, "organization_id", "left"), "catalog_id")


def indexed(content: Column) -> list[Column]:
    """content, cut at MAX_CONTENT, and what was cut."""
    length = F.length(F.coalesce(content, F.lit("")))
    return [
        F.when(length > 0, F.substring(content, 1, MAX_CONTENT)).alias("content"),
        (length > MAX_CONTENT).alias("content_truncated"),
        length.cast("long").alias("original_chars"),
        F.least(length, F.lit(MAX_CONTENT)).cast("long").alias("indexed_chars"),
    ]


def meeting_documents(star: DataFrame) -> DataFrame:
    """Search documents of meetings: content is cut at MAX_CONTENT, and what was cut is told. A star that has _content, the key of each content, and the other columns of indexed() keeps them."""
    content = ["_content", "content_truncated", "original_chars", "indexed_chars"] if "_content" in star.columns else indexed(F.col("content"))
    return star.select(
        F.concat(F.lit("doc_"), F.col("id").cast("string")).alias("id"),
        F.col("id").alias("db_id"),
        F.lit("meeting").alias("result_type"),
        "event_id",
        "catalog_id",
        "city",
        F.coalesce("organization", F.lit("City Council")).alias("organization"),
        X.meeting_category(F.col("meeting_type")).alias("meeting_category"),
        F.date_format("record_date", "yyyy-MM-dd").alias("date"),
        "event_name",
        X.document_kind(F.col("category")).alias("kind"),
        *content,
        "topics",
    )


def item_documents(star: DataFrame) -> DataFrame:
    """Search documents of agenda items, without tags in the title."""
    return star.select(
        F.concat(F.lit("item_"), F.col("id").cast("string")).alias("id"),
        F.col("id").alias("db_id"),
        F.lit("agenda_item").alias("result_type"),
        "event_id",
        "catalog_id",
        "city",
        F.coalesce("organization", F.lit("City Council")).alias("organization"),
        X.meeting_category(F.col("meeting_type")).alias("meeting_category"),
        F.date_format("record_date", "yyyy-MM-dd").alias("date"),
        X.html_stripped(F.col("title")).alias("title"),
    )


def search_table(meetings: DataFrame, items: DataFrame) -> DataFrame:
    """Meetings and agenda items as one table."""
    return meetings.unionByName(items, allowMissingColumns=True)


def facets(meetings: DataFrame) -> DataFrame:
    """facet, value, n: documents of each city, organization, category and topic."""
    values = F.array(*(F.struct(F.lit(n).alias("facet"), F.col(n).alias("value")) for n in ("city", "organization", "meeting_category")))
    topics = F.transform(F.array_distinct(F.coalesce("topics", F.array().cast("array<string>"))), lambda t: F.struct(F.lit("topics").alias("facet"), t.alias("value")))
    return meetings.select(F.explode(F.concat(values, topics)).alias("f")).select("f.*").filter("value IS NOT NULL").groupBy("facet", "value").agg(F.count("*").alias("n"))


def _topics(meetings: DataFrame) -> DataFrame:
    t = meetings.select("city", F.col("date").cast("date").alias("day"), F.explode("topics").alias("topic")).withColumn("topic", X.collapse(F.col("topic")))
    return t.filter((F.col("topic") != "") & ~X.is_trend_noise(F.col("topic")))


def topic_counts(meetings: DataFrame, date_from: str | None = None, date_to: str | None = None, limit: int = 20) -> DataFrame:
    """topic, n: the commonest topics of meetings in a range of days."""
    t = _topics(meetings)
    t = t.filter(F.col("day") >= date_from) if date_from else t
    t = t.filter(F.col("day") <= date_to) if date_to else t
    return t.groupBy("topic").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.lower("topic"), "topic").limit(limit)


def trends_compare(meetings: DataFrame, cities: list[str], date_from: str, date_to: str, granularity: str = "month", limit: int = 5) -> DataFrame:
    """city, bucket, topic, n: the range's top topics of all cities together, for each city and month or quarter, zero where there is none.

    The first bucket begins with its calendar month or quarter; the last ends with the range.
    """
    t = _topics(meetings.filter(F.col("city").isin(cities)))
    top = t.filter(F.col("day").between(date_from, date_to)).groupBy("topic").agg(F.count("*").alias("all")).orderBy(F.desc("all"), F.lower("topic"), "topic").limit(limit).select("topic")
    spark = meetings.sparkSession
    step = F.expr("INTERVAL 1 MONTH" if granularity == "month" else "INTERVAL 3 MONTH")
    first = F.trunc(F.lit(date_from).cast("date"), granularity)
    grid = spark.createDataFrame([(c,) for c in cities], "city string").select("city", F.explode(F.sequence(first, F.lit(date_to).cast("date"), step)).alias("bucket"))
    grid = grid.crossJoin(F.broadcast(top))  # cities x buckets x limit rows
    counted = t.join(F.broadcast(top), "topic", "left_semi").filter((F.col("day") >= first) & (F.col("day") <= date_to)).groupBy("city", F.trunc("day", granularity).alias("bucket"), "topic").agg(F.count("*").alias("n"))
    return grid.join(counted, ["city", "bucket", "topic"], "left").select("city", "bucket", "topic", F.coalesce("n", F.lit(0)).alias("n"))


def page(documents: DataFrame, sort: str = "newest", limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of results; ties by id. newest and oldest put null dates last."""
    if sort not in ("newest", "oldest", "relevance"):
        raise ValueError(f"unknown sort {sort!r}")
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError("limit must be 1 to 100 and offset 0 or more")
    order = {"newest": [F.desc_nulls_last("date"), "id"], "oldest": [F.asc_nulls_last("date"), "id"], "relevance": [F.desc("score"), "id"]}[sort]
    return documents.orderBy(*order).offset(offset).limit(limit)


def _equals(term: str):
    return lambda w: w == F.lit(term)


def lexical_search(documents: DataFrame, query: str, fields: tuple[str, ...] = ("event_name", "content", "organization"), limit: int = 20) -> DataFrame:
    """id, matched, field_rank, score: documents with most of the query's terms, then the earlier field, then BM25 summed over terms and fields; ties by id."""
    terms = sorted(set(query.lower().split()))
    if not terms:
        return documents.select("id", F.lit(0).alias("matched"), F.lit(0).alias("field_rank"), F.lit(0.0).alias("score")).limit(0)
    each = F.array(*(F.struct(F.lit(i).alias("field"), F.regexp_extract_all(F.lower(F.coalesce(F.col(n).cast("string"), F.lit(""))), F.lit(r"[\p{L}\p{N}']+"), 0).alias("words")) for i, n in enumerate(fields)))
    flat = documents.select("id", F.explode(each).alias("f")).select("id", "f.field", "f.words")
    counted = flat.select("id", "field", F.size("words").alias("dl"), F.explode(F.array(*(F.struct(F.lit(t).alias("term"), F.size(F.filter("words", _equals(t))).alias("tf")) for t in terms))).alias("h")).select("id", "field", "dl", "h.*")
    sizes = flat.groupBy("field").agg(F.avg(F.size("words")).alias("avgdl"), F.count("*").alias("docs"))
    hits = counted.filter("tf > 0")
    df = hits.groupBy("field", "term").agg(F.count("*").alias("df"))
    scored = hits.join(F.broadcast(sizes), "field").join(F.broadcast(df), ["field", "term"])  # a row for each field, and for each field and term
    bm25 = F.ln(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * 2.2 / (F.col("tf") + 1.2 * (0.25 + 0.75 * F.col("dl") / F.col("avgdl")))
    out = scored.groupBy("id").agg(F.countDistinct("term").alias("matched"), F.min("field").alias("field_rank"), F.round(F.sum(bm25), 6).alias("score"))
    return out.orderBy(F.desc("matched"), "field_rank", F.desc("score"), "id").limit(limit)


def with_aliases(rows: DataFrame, city: str, source: str = "source") -> DataFrame:
    """Rows whose source is the city or one of its former names."""
    return rows.filter(F.col(source).isin([city, *ALIASES.get(city, [])]))


def best_candidates(candidates: DataFrame) -> DataFrame:
    """Of several scores of one meeting or agenda item the best; the first among equals."""
    kind = F.coalesce("result_type", F.lit("meeting"))
    key = F.when(kind == "meeting", F.coalesce("catalog_id", F.lit(0))).otherwise(F.coalesce("db_id", F.lit(0)))
    best = Window.partitionBy(F.when(kind == "meeting", "meeting").otherwise("agenda_item"), key).orderBy(F.desc("score"), "row_id")
    return candidates.withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n")


def with_lexical_fallback(semantic: DataFrame, lexical: DataFrame) -> DataFrame:
    """Semantic candidates, then lexical hits of other catalogs with score -(rank + 1); place keeps the order."""
    s = semantic.select("catalog_id", "score", F.struct(F.lit(0).alias("part"), (-F.col("score")).alias("by")).alias("place"))
    added = lexical.join(semantic.select("catalog_id"), "catalog_id", "left_anti").groupBy("catalog_id").agg(F.min("rank").alias("rank"))
    return s.union(added.select("catalog_id", (-(F.col("rank") + 1)).cast("double"), F.struct(F.lit(1), F.col("rank").cast("double"))))


def lineage_timeline(star: DataFrame, lineage: DataFrame, lineage_id: str, least_confidence: float = 0.0) -> DataFrame:
    """Meetings of one lineage, newest first; a null date counts as newest."""
    own = lineage.filter((F.col("lineage_id") == lineage_id) & (F.col("confidence") >= least_confidence))
    return star.join(own, "catalog_id").orderBy(F.desc_nulls_first("record_date"), F.desc("id"))
