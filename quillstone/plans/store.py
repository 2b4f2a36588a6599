"""The history of runs as a store of versions: a folder for each bucket of ids, to which changes are only ever added, and compaction.

A change is a row: a saved record, a new name, or a deletion. What a record is now follows from its changes in the order of their times, so
writers need no lock and no read before a write: a name and a record that are written at once both count.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a store. A lookup reads one of them.
BUCKETS = 64
CHANGE = "id string, kind string, value string, changed double, writer string"


def bucket_of(record_id: Column) -> Column:
    return F.pmod(F.crc32(record_id.cast("binary")), F.lit(BUCKETS)).cast("int")


def change(changes: DataFrame, path: str) -> None:
    """Adds changes (id, kind: save, rename or delete; value: the record or name; changed: seconds). A row without an id or time is left out."""
    rows = changes.where("id IS NOT NULL AND changed IS NOT NULL").withColumns({"writer": F.lit(uuid.uuid4().hex), "bucket": bucket_of(F.col("id"))})
    rows.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(path)


def save(records: DataFrame, path: str) -> None:
    """Adds records (id, record as JSON, changed: seconds)."""
    change(records.select("id", F.lit("save").alias("kind"), F.col("record").alias("value"), F.col("changed").cast("double").alias("changed")), path)


def _now(changes: DataFrame) -> DataFrame:
    """id, record of changes: the latest save that no later deletion takes back, under the latest name given since."""
    at = F.struct("changed", "writer")
    last = lambda kind: F.max(F.when(F.col("kind") == kind, F.struct(at.alias("at"), "value")))
    rows = changes.groupBy("id").agg(last("save").alias("s"), last("rename").alias("r"), last("delete").alias("d"))
    rows = rows.where(F.col("s").isNotNull() & (F.col("d").isNull() | (F.col("s.at.changed") > F.col("d.at.changed"))))
    whole = F.parse_json("s.value").cast("map<string,variant>")
    named = F.to_json(F.map_concat(F.map_filter(whole, lambda k, _: k != "name"), F.create_map(F.lit("name"), F.parse_json(F.to_json(F.array(F.col("r.value")))).cast("array<variant>")[0])))
    newer = F.col("r").isNotNull() & (F.col("r.at") > F.col("s.at"))
    return rows.select("id", F.when(newer, named).otherwise(F.col("s.value")).alias("record"))


def _files(spark: SparkSession, folder: str) -> list[str]:
    """The Parquet files of a folder; none, if it isn't there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not system.exists(path):
        return []
    return sorted(str(f.getPath()) for f in system.listStatus(path) if f.getPath().getName().endswith(".parquet"))


def _read(spark: SparkSession, files: list[str]) -> DataFrame:
    return spark.read.schema(CHANGE).parquet(*files) if files else spark.createDataFrame([], CHANGE)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """id, record of all records of a store."""
    return _now(spark.read.schema(CHANGE).parquet(path))


def changes_of(spark: SparkSession, path: str, record_id: str) -> DataFrame:
    """All changes of one record: the files of its bucket are all that is listed and read."""
    bucket = spark.range(1).select(bucket_of(F.lit(record_id))).first()[0]
    return _read(spark, _files(spark, f"{path}/bucket={bucket}")).where(F.col("id") == record_id)


def get_record(spark: SparkSession, path: str, record_id: str) -> str | None:
    """A record as JSON, or None."""
    row = _now(changes_of(spark, path, record_id)).first()
    return row and row["record"]


def _change(spark: SparkSession, path: str, record_id: str, kind: str, value: str | None, changed: float) -> bool:
    if get_record(spark, path, record_id) is None:
        return False
    change(spark.createDataFrame([(record_id, kind, value, float(changed))], "id string, kind string, value string, changed double"), path)
    return True


def rename_record(spark: SparkSession, path: str, record_id: str, name: str, changed: float) -> bool:
    """Names a record; whether there was one. A blank name changes nothing. A deletion, whoever writes it and when, is never undone."""
    if not name.strip():
        return get_record(spark, path, record_id) is not None
    return _change(spark, path, record_id, "rename", name.strip(), changed)


def delete_record(spark: SparkSession, path: str, record_id: str, changed: float) -> bool:
    """Deletes a record; whether there was one."""
    return _change(spark, path, record_id, "delete", None, changed)


def compact(spark: SparkSession, path: str, bucket: int) -> list[str]:
    """Writes the changes of a bucket that still count as one file more, and gives the files that this makes needless, for `sweep`.

    Changes that are added meanwhile are in other files, which stay. Until the sweep, changes are there twice, which tells readers nothing new. Of a record the
    last change of each kind is kept, deletions too, so that a late copy of an old save stays deleted.
    """
    files = _files(spark, f"{path}/bucket={bucket}")
    if len(files) < 2:
        return []
    last = _read(spark, files).groupBy("id", "kind").agg(F.max(F.struct("changed", "writer", "value")).alias("c"))
    rows = last.select("id", "kind", "c.value", "c.changed", "c.writer", F.lit(bucket).alias("bucket"))
    rows.coalesce(1).write.mode("append").partitionBy("bucket").parquet(path)
    return files


def sweep(spark: SparkSession, files: list[str]) -> None:
    """Deletes files that compact made needless, once readers that began before it are done."""
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    for name in files:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, False)
