"""Tables in the shared folder: steps of iterative jobs, and versioned tables whose changes are made once."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A key with more rows than LEAST, and than one in SHARE of all, is hot: there are fewer than SHARE such keys.
LEAST, SHARE = 10_000, 1000

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a session in one process, as in tests, gets a folder of its own where none is set, on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (folder or _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="spark-shared-"))).rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, so that lineage ends there."""
    path = new_folder(df.sparkSession, "step")
    df.write.parquet(path)
    again = df.sparkSession.read.schema(df.schema).parquet(path)
    again._step_path = path
    return again


def _path(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def drop(*steps: DataFrame | None) -> None:
    """Delete tables that checkpointed() wrote and nothing reads any more."""
    for df in steps:
        if df is not None and hasattr(df, "_step_path"):
            system, path = _path(df.sparkSession, df._step_path)
            system.delete(path, True)


def hot_keys(table: DataFrame, key: str, least: int = LEAST) -> DataFrame | None:
    """(key, _parts): to how many tasks each hot key of a written table is dealt; None if none is hot."""
    total = table.count()
    if total <= least:
        return None
    per = max(least, total // SHARE)
    counts = table.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > per)
    rows = counts.select(key, F.ceil(F.col("n") / per).cast("int").alias("_parts")).collect()  # fewer than SHARE
    schema = table.select(key).schema.add("_parts", "integer")
    return table.sparkSession.createDataFrame(rows, schema) if rows else None


def spread_join(left: DataFrame, right: DataFrame, key: str, by: str, hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """left.join(right, key, how), inner or left, with left's rows of hot keys dealt to several tasks by the column by, and right's repeated for them."""
    if hot is None:
        return left.join(right, key, how)
    listed = F.broadcast(hot)  # fewer than SHARE rows
    part = F.pmod(F.xxhash64(by), F.coalesce("_parts", F.lit(1))).cast("int")
    dealt = left.join(listed, key, "left").withColumn("_part", part).drop("_parts")
    repeated = right.join(listed, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return dealt.join(repeated, [key, "_part"], how).drop("_part")


class Versioned:
    """A table in a folder, as numbered snapshots; the one with the highest number that is complete is the table.

    A batch has an id and is applied once: its snapshot is written aside and renamed to its place under the next number, with the batch's
    id in its name, so a batch that comes again finds its snapshot and changes nothing, and a reader sees the table before or after a
    batch, never between. One writer at a time; a writer that dies leaves only a folder aside.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _snapshots(self) -> list[tuple[int, str]]:
        system, path = _path(self.spark, self.folder)
        if not system.exists(path):
            return []
        names = [s.getPath().getName() for s in system.listStatus(path)]
        found = [n.split("=", 1) for n in names if "=" in n]
        return sorted((int(number), batch) for number, batch in found)

    def batches(self) -> list[str]:
        """The batches applied, in order."""
        return [batch for _, batch in self._snapshots()]

    def read(self, version: int | None = None) -> DataFrame:
        found = self._snapshots()
        number, batch = found[-1] if version is None else next(x for x in found if x[0] == version)
        path = f"{self.folder}/{number:08d}={batch}"
        schema = StructType.fromJson(json.loads(self.spark.read.text(f"{path}/_schema").first()[0]))
        return self.spark.read.schema(schema).parquet(path)

    def apply(self, batch: str, change, partition_by: tuple[str, ...] = ()) -> bool:
        """Write change(the table, or None at first) as the next snapshot; False, and nothing else, if the batch was applied before."""
        if not batch or "/" in batch or "=" in batch or batch.startswith((".", "_")):
            raise ValueError(f"{batch!r} is no name of a batch")
        found = self._snapshots()
        if batch in (b for _, b in found):
            return False
        aside = f"{self.folder}/_{uuid.uuid4().hex}"
        rows = change(self.read() if found else None)
        rows.write.partitionBy(*partition_by).parquet(aside)
        # an empty table has no file that tells its columns
        self.spark.createDataFrame([(rows.schema.json(),)], "schema string").coalesce(1).write.text(f"{aside}/_schema")
        number = found[-1][0] + 1 if found else 0
        system, path = _path(self.spark, aside)
        if not system.rename(path, _path(self.spark, f"{self.folder}/{number:08d}={batch}")[1]):
            raise RuntimeError(f"snapshot {number} of {self.folder} could not be put in its place")
        return True

    def expire(self, keep: int = 2) -> None:
        """Delete the rows of all but the last snapshots; their names stay, so that their batches still count as applied."""
        for number, batch in self._snapshots()[:-keep]:
            system, path = _path(self.spark, f"{self.folder}/{number:08d}={batch}")
            for status in system.listStatus(path):
                system.delete(status.getPath(), True)
