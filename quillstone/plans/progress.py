"""Progress of a job while it runs: counts that Spark observes as a stage's rows pass, added to a table that anyone can read meanwhile."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.listener import QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent, StreamingQueryListener

PROGRESS = "job string, stage string, at double, counts map<string,bigint>"


class ProgressTable:
    """Rows of PROGRESS in a shared folder, a small file for each: writers don't wait for each other, and readers see whole rows only."""

    def __init__(self, spark: SparkSession, path: str, job: str) -> None:
        self.spark, self.path, self.job = spark, path, job

    def __call__(self, stage: str, counts: dict[str, int]) -> None:
        row = {"job": self.job, "stage": stage, "at": time.time(), "counts": {k: int(v or 0) for k, v in counts.items()}}
        jvm = self.spark._jvm
        place, name = (jvm.org.apache.hadoop.fs.Path(self.path, f"{dot}{uuid.uuid4().hex}.json") for dot in ("_", ""))
        system = place.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        out = system.create(place)
        out.write(bytearray(json.dumps(row).encode() + b"\n"))
        out.close()
        system.rename(place, name)  # names that begin with "_" are not read

    def read(self) -> DataFrame:
        """What has been reported so far, by all jobs of this table."""
        return self.spark.read.schema(PROGRESS).json(self.path)


class StreamProgress(StreamingQueryListener):
    """Reports what each micro-batch of a query of the given name has observed (df.observe with named counts), and its input rows."""

    def __init__(self, table: ProgressTable, query: str) -> None:
        self.table, self.query = table, query

    def onQueryStarted(self, event: QueryStartedEvent) -> None:  # noqa: N802
        if event.name == self.query:
            self.table("started", {})

    def onQueryProgress(self, event: QueryProgressEvent) -> None:  # noqa: N802
        p = event.progress
        if p.name == self.query:
            for stage, row in p.observedMetrics.items():
                self.table(stage, {"batch": p.batchId, **row.asDict()})

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:  # noqa: N802
        pass
