"""Written boundaries between steps of a job."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset and all run on one machine, as in tests, a temporary one is set."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="quillstone-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Hears of a stage and of what was counted as its rows were written.
Progress = Callable[[str, dict[str, int]], None]


def written(df: DataFrame, name: str, progress: Progress | None = None, **counts: Column) -> DataFrame:
    """df as a Parquet table in the shared folder: what is dear or has effects runs once, and lost executors don't bring it back.

    With `progress`, aggregates over df's columns are observed by the write itself and reported after it.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    seen = Observation() if progress and counts else None
    (df.observe(seen, *(c.alias(k) for k, c in counts.items())) if seen else df).write.parquet(path)
    if seen:
        progress(name, seen.get)
    return df.sparkSession.read.schema(df.schema).parquet(path)
