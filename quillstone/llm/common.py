"""What the operators of this subpackage share: the shared folder, and deterministic chunks of documents."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import math
import tempfile
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where all run on one machine, a temporary one is set in its place."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="quillstone-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read back, which cuts its lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_to = path
    return table


def discard(*tables: DataFrame | None) -> None:
    """Deletes materialised tables that nothing reads any more."""
    for table in tables:
        if path := getattr(table, "_written_to", None):
            jvm, session = table.sparkSession._jvm, table.sparkSession._jsparkSession
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(session.sessionState().newHadoopConf()).delete(where, True)
            table._written_to = None


def free_shuffles(spark: SparkSession) -> None:
    """Shuffle files go when their plan does: frees the plans of jobs that are over. One collection only finds them, the next lets go."""
    for _ in range(3):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.1)


def bound_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Arrow batches hold `most` bytes at most, unless the session sets a limit: ten thousand long texts would not fit a worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("b")) > 1 << 28:
        spark.conf.set(key, str(most))


def release_memory() -> None:
    """Gives freed memory back to the system: workers live on from task to task, and so would the peaks of each."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # elsewhere than on glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a column: one aggregate row, whatever the size of the table."""
    return docs.agg(F.sum(F.octet_length(column))).first()[0] or 0


def grown(chunk_bytes: int, total: int, base: int = 1 << 30, most: int = 64 << 20) -> int:
    """Bytes of a chunk: they grow with the root of the text beyond `base`, to `most`, so that a row for each chunk and bucket makes rows in proportion to the text."""
    return max(chunk_bytes, min(most, int(chunk_bytes * math.sqrt(max(1.0, total / base)))))


def chunk_count(docs: DataFrame, column: str, chunk_bytes: int, least: int = 2) -> int:
    """Chunks of about grown(chunk_bytes) of text, and at least `least` times as many as shuffle partitions, for even tasks."""
    total = text_bytes(docs, column)
    return max(least * partitions(docs.sparkSession), math.ceil(total / grown(chunk_bytes, total)))


def in_chunks(docs: DataFrame, n_chunks: int) -> DataFrame:
    """docs with a column `chunk` that depends on id and text alone: every pass over a chunk sees the same rows, and different texts of one id spread."""
    return docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_chunks)))


def in_order(table: pa.Table) -> pa.Table:
    """The rows of a chunk in the order of doc_id and text, so that every pass over it numbers them alike."""
    ids, texts = table["doc_id"].to_pylist(), table["text"].to_pylist()
    return table.take(sorted(range(len(ids)), key=lambda i: (ids[i], texts[i] or "")))


def texts_of(table: pa.Table | pa.RecordBatch) -> list[bytes]:
    """UTF-8 texts; a null text is empty."""
    return [t or b"" for t in table["text"].cast(pa.binary()).to_pylist()]


def ordered_texts(table: pa.Table) -> tuple[list[int], list[bytes]]:
    """Ids and texts of a chunk in order."""
    table = in_order(table)
    return table["doc_id"].to_pylist(), texts_of(table)


def in_parts(batches: Iterator[pa.RecordBatch], most: int = 2 << 20) -> Iterator[tuple[list, list[bytes], pa.RecordBatch]]:
    """Ids, texts and rows of parts of the batches, each with about `most` bytes of text, or one longer text."""
    for batch in batches:
        texts, at, held = texts_of(batch), 0, 0
        for i, text in enumerate(texts):
            held += len(text)
            if held >= most or i == len(texts) - 1:
                part = batch.slice(at, i + 1 - at)
                yield part["doc_id"].to_pylist(), texts[at : i + 1], part
                at, held = i + 1, 0
        del texts
        release_memory()
