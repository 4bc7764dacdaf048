"""WARC archives: writing, and reading by boundary-chain verification (operator 10).

Writing is DataFrame work: a record is a text value, and the text writer's line
separator is the blank lines that end a record, so tasks write whole archives,
compressed, to any store. Pages of equal payload (at least MIN_REVISIT_BYTES) are grouped by
digest; the largest page_id is the response and the others are revisits without
the body.

Reading does not trust the magic string, which payloads may contain. Tasks look
for every place where a record header can be parsed and emit its offset, its
successor's offset (header, declared length and the closing blank lines) and what
the record says. Pointer jumping in Spark, with the pointers doubled in each
round, then finds the offsets reachable from the start of each file; only those
are records. A chain that does not reach the end of its file is an error.

Defined results: a null html is an empty payload; null page_ids are never grouped;
repeated rows with the largest page_id of a group are all responses; a null url
has no target header; an empty table gives no archive and no rows; other columns
are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, cut, drop, shared_dir

MAGIC = b"WARC/1.1\r\n"
END = "\r\n\r\n"
MIN_REVISIT_BYTES = 1000
#: Records of an archive file at most, and about so many bytes (or a single record).
FILE_RECORDS, FILE_BYTES = 2000, 256 << 20
SALTS = 32

_RECORDS = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("at", T.LongType()),
        T.StructField("next", T.LongType()),
        T.StructField("page_id", T.LongType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
    ]
)


def plan_records(pages: DataFrame) -> DataFrame:
    """page_id, url, payload (binary; null for revisits), payload_bytes, payload_digest, record_type, refers_to."""
    d = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    d = d.withColumn("payload_bytes", F.length("payload").cast("long")).withColumn("payload_digest", F.sha1("payload"))
    large = d.filter((F.col("payload_bytes") >= MIN_REVISIT_BYTES) & F.col("page_id").isNotNull())
    groups = large.groupBy("payload_digest").agg(F.max("page_id").alias("_last"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    # a group may hold a third of all pages: its pages go to SALTS places
    salted = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    d = d.withColumn("_salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(salted, ["payload_digest", "_salt"], "left")
    revisit = F.coalesce(F.col("page_id") < F.col("_last"), F.lit(False))
    return d.select(
        "page_id",
        "url",
        F.when(~revisit, F.col("payload")).alias("payload"),
        "payload_bytes",
        "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("_last")).alias("refers_to"),
    )


def write_warc(records: DataFrame, path: str) -> None:
    """Archives (gzip) of at most FILE_RECORDS records and about FILE_BYTES each, in subfolders by the size of records, in any store that Spark can write. Offsets are those of the uncompressed bytes."""
    line = "\r\n"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{line}Content-Type: text/html; charset=UTF-8{line}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    block = F.concat(http, F.coalesce(F.decode("payload", "UTF-8"), F.lit("")))
    head = F.concat_ws(
        line,
        F.lit(MAGIC.decode().strip()),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")),
        F.lit("WARC-Date: 2024-01-01T00:00:00Z"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.when(F.col("refers_to").isNotNull(), F.concat(F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{line}WARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(F.col("_block")).cast("string")),
    )
    # records of a class have at most FILE_BYTES / FILE_RECORDS bytes times 4 ** class; a url's byte may become three
    most = F.col("payload_bytes") + 3 * F.coalesce(F.octet_length("url"), F.lit(0)) + 1024
    size = F.greatest(F.lit(0), F.ceil(F.log(4.0, most * FILE_RECORDS / FILE_BYTES))).cast("int")
    found = sorted(r[0] for r in records.select(size.alias("size")).distinct().collect()) or [0]  # a row for each power of four
    for k in found:
        part = records.filter(size == k) if len(found) > 1 else records
        lines = part.withColumn("_block", block).select(F.concat(head, F.lit(END), F.col("_block")).alias("value"))
        lines.write.option("lineSep", END).option("maxRecordsPerFile", max(1, FILE_RECORDS >> 2 * k)).option("compression", "gzip").text(f"{path}/size-{k}")


def _candidate(data: bytes, at: int, before: int) -> tuple | None:
    """What the record at this offset says, if a header that ends before the next magic string can be parsed there and its block fits."""
    import hashlib

    stop = data.find(b"\r\n\r\n", at, before)
    if stop < 0:
        return None
    fields = {}
    for line in data[at + len(MAGIC) : stop].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.lower()] = value.strip().decode("utf-8", "replace")
    size = fields.get(b"content-length", "")
    start = stop + 4
    if not size.isdigit() or start + int(size) + 4 > len(data) or data[start + int(size) : start + int(size) + 4] != b"\r\n\r\n":
        return None
    end = start + int(size)
    kind, digest, length = fields.get(b"warc-type"), fields.get(b"warc-payload-digest", "").removeprefix("sha1:"), 0
    body = data.find(b"\r\n\r\n", start, end)
    if kind == "response" and body >= 0:
        digest, length = hashlib.sha1(memoryview(data)[body + 4 : end]).hexdigest(), end - body - 4  # of what was read
    elif body >= 0:
        stated = [x.partition(b":")[2] for x in data[start:body].split(b"\r\n") if x.lower().startswith(b"content-length:")]
        length = int(stated[0]) if stated else 0

    def number(name: bytes) -> int | None:
        text = fields.get(name, "").removeprefix("<urn:page:").removesuffix(">")
        return int(text) if text.lstrip("-").isdigit() else None

    return end + 4, number(b"warc-record-id"), kind, number(b"warc-refers-to"), length, digest


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Every offset at which a record can be read, with its successor's offset, and the end of each file without one."""

    def run(batches):
        import gzip

        import pyarrow as pa

        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = gzip.decompress(data)
                rows, at = [(file, len(data), *[None] * 6)], data.find(MAGIC)
                while at >= 0:
                    after = data.find(MAGIC, at + 1)
                    if found := _candidate(data, at, after if after >= 0 else len(data)):
                        rows.append((file, at, *found))
                    at = after
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _arrow(), strict=True)], schema=_arrow())

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")  # a row is a file; a file's size is bounded by FILE_RECORDS and FILE_BYTES
    return files.select("path", "content").mapInArrow(run, _RECORDS)


def _arrow():
    import pyarrow as pa

    return pa.schema([("file", pa.string()), ("at", pa.int64()), ("next", pa.int64()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])


def reachable(nodes: DataFrame) -> DataFrame:
    """Of (file, at, next), a table of its own, the (file, at) on the chain from offset 0: after k rounds, all within 2^k steps of it. Both sides of each join grow with the archives, so neither is broadcast."""
    jumps = nodes.filter("next IS NOT NULL").select("file", "at", "next")
    reached = cut(nodes.filter("at = 0").select("file", "at"))
    count, there = reached.count(), nodes.select("file", "at")
    while True:
        step = reached.join(jumps.hint("merge"), ["file", "at"]).select("file", F.col("next").alias("at"))
        grown = cut(reached.union(step.join(there.hint("merge"), ["file", "at"], "left_semi")).distinct())
        drop(reached)
        reached, before, count = grown, count, grown.count()
        if count == before:
            drop(jumps)
            return reached
        second = jumps.select("file", F.col("at").alias("next"), F.col("next").alias("far"))
        doubled = cut(jumps.join(second.hint("merge"), ["file", "next"]).select("file", "at", F.col("far").alias("next")))
        drop(jumps)
        jumps = doubled


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives in a folder: file, at, page_id, record_type, refers_to, payload_bytes, payload_digest."""
    nodes = cut(candidates(spark, path))
    bounded_batches(spark)
    reached = reachable(nodes)
    if broken := nodes.filter("next IS NULL").join(reached.hint("merge"), ["file", "at"], "left_anti").first():
        raise ValueError(f"the records of {broken.file} do not reach its end, {broken.at}")
    return nodes.filter("next IS NOT NULL").join(reached.hint("merge"), ["file", "at"], "left_semi").drop("next")


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write the pages as archives, then read those: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(plan_records(pages), path)
    return read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
