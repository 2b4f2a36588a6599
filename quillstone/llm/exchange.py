"""Packed exchange: many small keys travel as a few binary rows.

Documents are dealt into chunks by id. Each chunk sends its distinct 64-bit keys to buckets (ranges of the key), one binary row for
each chunk and bucket; a bucket adds up what all chunks sent and answers each of them in the order of its keys. A chunk recomputes its
keys when the answer comes, so keys don't travel back. A hot key costs one entry for each chunk, not one for each occurrence.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillstone.llm.common import release_memory

ANSWER = "chunk long, bucket int, payload binary"


def bucket_of(keys: np.ndarray, n_buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and how often each occurs."""
    return np.unique(keys, return_counts=True)


def tally(chunks: DataFrame, keys_of: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]], n_buckets: int, answer: Callable[[np.ndarray], np.ndarray], key_type: str = "<u8", summary: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """ANSWER rows: for each chunk and bucket, answer(sum of counts over all chunks) of each of the chunk's keys, in their order.

    keys_of(chunk) gives sorted distinct keys and their counts. With key_type '<u4' only the low 32 bits travel: a bucket's keys
    that agree in them are taken for one, which suits filters and orderings but not counts that must be exact. With `summary`, each bucket also gives summary(its distinct
    keys, their sums) in a row of chunk -1.
    """

    def sent(table: pa.Table) -> pa.Table:
        keys, counts = keys_of(table)
        cuts = np.searchsorted(bucket_of(keys, n_buckets), np.arange(n_buckets + 1))
        used = np.flatnonzero(np.diff(cuts))
        kind = np.min_scalar_type(int(counts.max())) if len(counts) else np.dtype("u1")
        small, counts = keys.astype(key_type), counts.astype(kind)
        release_memory()
        part = lambda a: [a[cuts[b] : cuts[b + 1]].tobytes() for b in used]
        same = lambda v, t: pa.array([v] * len(used), t)
        return pa.table({"bucket": pa.array(used, pa.int32()), "chunk": same(table["chunk"][0].as_py(), pa.int64()), "width": same(kind.itemsize, pa.int32()), "keys": pa.array(part(small), pa.binary()), "counts": pa.array(part(counts), pa.binary())})

    def added(table: pa.Table) -> pa.Table:
        raw = table["keys"].to_pylist()
        keys = np.frombuffer(b"".join(raw), key_type)
        counts = np.concatenate([np.frombuffer(c, f"<u{w}").astype(np.uint64) for c, w in zip(table["counts"].to_pylist(), table["width"].to_pylist(), strict=True)])
        known, at = np.unique(keys, return_inverse=True)
        total = np.zeros(int(at.max()) + 1, np.uint64)
        np.add.at(total, at, counts)
        values = answer(total)[at]
        size = np.cumsum([0, *(len(r) // np.dtype(key_type).itemsize for r in raw)])
        chunks, buckets, payloads = table["chunk"].to_pylist(), table["bucket"].to_pylist(), [values[a:b].tobytes() for a, b in zip(size, size[1:])]
        if summary:
            chunks, buckets, payloads = [*chunks, -1], [*buckets, buckets[0]], [*payloads, summary(known, total).tobytes()]
        return pa.table({"chunk": pa.array(chunks, pa.int64()), "bucket": pa.array(buckets, pa.int32()), "payload": pa.array(payloads, pa.binary())})

    def send(table: pa.Table) -> pa.Table:
        out = sent(table)
        release_memory()
        return out

    def add(table: pa.Table) -> pa.Table:
        out = added(table)
        release_memory()
        return out

    rows = chunks.groupBy("chunk").applyInArrow(send, "bucket int, chunk long, width int, keys binary, counts binary")
    return rows.groupBy("bucket").applyInArrow(add, ANSWER)


def values(answers: pa.Table, dtype: str) -> np.ndarray:
    """A chunk's answers in the order of its sorted keys."""
    order = np.argsort(answers["bucket"].to_numpy())
    rows = answers["payload"].to_pylist()
    return np.frombuffer(b"".join(rows[i] for i in order), dtype)
