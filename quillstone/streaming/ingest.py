"""Arriving documents as a stream: each micro-batch goes through the batch operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

DOCUMENTS = "batch_id long, doc_index int, text string"


def stream_documents(spark: SparkSession, path: str, schema: str = DOCUMENTS, max_files: int = 100) -> DataFrame:
    """Parquet files of documents as they arrive under path."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def start(documents: DataFrame, out: str, checkpoint: str, operator: Callable[[DataFrame], DataFrame], **trigger) -> StreamingQuery:
    """Runs `operator`, such as plans.process.process with a generator, on each micro-batch and writes its result under out, a folder for each epoch, so that a repeated epoch overwrites itself.

    Documents of one batch must arrive in one file.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
