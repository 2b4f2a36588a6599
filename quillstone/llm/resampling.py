"""Importance resampling towards a target: hashed n-gram features, weights of distinct texts, Gumbel top-k by document.

Equal texts are one row before anything is computed; their number multiplies their counts, and their weight comes back to each
document before the document's own noise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.common import bound_batches, discard, materialise
from quillstone.llm.terms import ALPHANUMERIC, CRC_START, crc_states, crc_step, term_spans, text_parts

#: A text that holds more than one in HEAVY of all rows is met by broadcast: there are fewer than HEAVY such texts.
HEAVY = 4096

_SPARSE = "key binary, copies long, n_words long, n_features long, buckets binary"


def features(texts: list[bytes], longest: int, n_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of each text; each feature's text and bucket, in this order. Features are all runs of 1 to `longest` words, joined by a space."""
    buffer, doc, starts, ends = term_spans(texts, ALPHANUMERIC)
    words = np.bincount(doc, minlength=len(texts))
    keys, state, head = [], np.full(len(starts), CRC_START, np.uint32), np.arange(len(starts))
    for n in range(1, longest + 1):
        last = head + n - 1
        state = crc_states(buffer, starts[last], ends[last], state)
        keys.append(doc[head] * n_buckets + ((state ^ CRC_START) % np.uint32(n_buckets)).astype(np.int64))
        more = np.flatnonzero(last + 1 < len(starts))
        more = more[doc[head[more]] == doc[last[more] + 1]]
        head, state = head[more], crc_step(state[more], 0x20)
    key = np.concatenate(keys)
    key.sort()
    return words, key // n_buckets, key % n_buckets


def _pack(longest: int, n_buckets: int):
    """_SPARSE rows: a text's buckets in order, as steps of two bytes, which compress well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, part in text_parts(batches, 4 << 20):
            words, doc, bucket = features(texts, longest, n_buckets)
            size = np.bincount(doc, minlength=len(texts))
            cuts = np.append(0, np.cumsum(size))
            step = np.diff(bucket, prepend=0)
            first = cuts[:-1][size > 0]
            step[first] = bucket[first]
            raw = step.astype("<u2").tobytes()
            rows = [raw[2 * a : 2 * b] for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([part["key"], part["copies"], pa.array(words, pa.int64()), pa.array(size, pa.int64()), pa.array(rows, pa.binary())], names=["key", "copies", "n_words", "n_features", "buckets"])

    return run


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of _SPARSE rows: the features of each, and their rows and buckets."""
    size = batch["n_features"].to_numpy()
    step = np.frombuffer(b"".join(batch["buckets"].to_pylist()), "<u2").astype(np.int64)
    total = np.append(0, np.cumsum(step))
    ahead = np.cumsum(size) - size
    return size, np.repeat(np.arange(len(size)), size), total[1:] - np.repeat(total[ahead], size)


def sparse_features(texts: DataFrame, longest: int, n_buckets: int) -> DataFrame:
    """_SPARSE rows, one for each distinct text: its SHA-256, its number of rows, and its features. A null text is an empty one."""
    whole = texts.groupBy(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).agg(F.count("*").alias("copies"))
    return whole.select(_key().alias("key"), "copies", "text").mapInArrow(_pack(longest, n_buckets), _SPARSE)


def _key():
    return F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256))


def bucket_counts(sparse: DataFrame, n_buckets: int) -> DataFrame:
    """bucket, n: features of all rows, copies counted each; each task sends one number a bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_buckets, np.int64)
        for batch in batches:
            size, _, bucket = _unpacked(batch)
            copies = np.repeat(batch["copies"].to_numpy(), size)
            for n in np.unique(copies):
                total += n * np.bincount(bucket[copies == n], minlength=n_buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    return sparse.select("copies", "n_features", "buckets").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, n_buckets: int) -> np.ndarray:
    """floor(1000 * ln((t + 1) * (S + n) / ((s + 1) * (T + n)))) of each of the n buckets, from their counts s and t and their sums S and T."""
    both = raw.select("bucket", F.col("n").alias("s"), F.lit(0).alias("t")).unionByName(target.select("bucket", F.lit(0).alias("s"), F.col("n").alias("t")))
    rows = both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).collect()  # n_buckets rows at most
    s, t = np.zeros(n_buckets, np.int64), np.zeros(n_buckets, np.int64)
    for r in rows:
        s[r["bucket"]], t[r["bucket"]] = r["s"], r["t"]
    one = np.float64(1)
    ratio = (t + one) * (s.sum() + np.float64(n_buckets)) / ((s + one) * (t.sum() + np.float64(n_buckets)))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def text_weights(sparse: DataFrame, gain: np.ndarray) -> DataFrame:
    """key, copies, n_words, n_features, weight of each distinct text: the floored mean of its features' gains, 0 without features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, _, bucket = _unpacked(batch)
            total = np.append(0, np.cumsum(gain[bucket]))
            cuts = np.append(0, np.cumsum(size))
            weight = (total[cuts[1:]] - total[cuts[:-1]]) // np.maximum(size, 1)
            yield pa.RecordBatch.from_arrays([batch["key"], batch["copies"], batch["n_words"], batch["n_features"], pa.array(weight, pa.int64())], names=["key", "copies", "n_words", "n_features", "weight"])

    return sparse.mapInArrow(run, "key binary, copies long, n_words long, n_features long, weight long")


def _each_document(docs: DataFrame, weights: DataFrame, n_rows: int) -> DataFrame:
    """doc_id with the n_words, n_features and weight of its text. Texts of very many rows are met by broadcast, so no key is hot in the shuffle."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key().alias("key"))
    heavy = F.col("copies") > max(1, n_rows // HEAVY)
    known = F.broadcast(weights.where(heavy).select("key", F.struct("n_words", "n_features", "weight").alias("_heavy")))
    light = weights.where(~heavy).select(F.col("key").alias("_key"), F.struct("n_words", "n_features", "weight").alias("_light"))
    rows = rows.join(known, "key", "left")
    # a row that is done needs a key that meets nothing and isn't that of all such rows
    own = F.when(F.col("_heavy").isNull(), F.col("key")).otherwise(F.concat_ws("#", F.spark_partition_id(), F.col("doc_id")).cast("binary"))
    found = rows.withColumn("_key", own).join(light, "_key", "left")
    return found.select("doc_id", F.inline(F.array(F.coalesce("_heavy", "_light"))))


def resample(docs: DataFrame, target: DataFrame, share: int = 25, seed: int = 7, longest: int = 2, n_buckets: int = 10_000, least_words: int = 20) -> DataFrame:
    """Every row of docs (doc_id, text): doc_id, n_features, weight, score, rank. `share` percent of the documents of least_words words are drawn.

    Features are runs of 1 to `longest` words, hashed into n_buckets. A bucket's gain compares its share in the target (text) with that in
    docs; a document's weight is the floored mean of its features' gains, its score the weight and noise that doc_id and seed decide.
    The highest scores are drawn, ties to the smaller doc_id; rank is null for others. Counts cover all rows, copies included.

    A null text is an empty one: no features, weight 0. A row with a null doc_id has no noise: its score is null, it is never drawn nor
    counted among those to draw from. Rows of one doc_id are separate documents. Empty tables: docs without rows give none, a target
    without rows makes all gains those of t = T = 0. Other columns are not read.
    """
    if not 1 <= n_buckets <= 1 << 16:
        raise ValueError("n_buckets must lie between 1 and 65536")
    spark = docs.sparkSession
    bound_batches(spark)
    sparse = materialise(sparse_features(docs, longest, n_buckets), "resample-features", compression="zstd")
    gain = gains(bucket_counts(sparse, n_buckets), bucket_counts(sparse_features(target, longest, n_buckets), n_buckets), n_buckets)
    n_rows = sparse.agg(F.sum("copies")).first()[0] or 0
    weights = materialise(text_weights(sparse, gain), "resample-weights")
    discard(sparse)
    share_of = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((share_of + 0.5) / 4294967296.0)))
    scored = _each_document(docs, weights, n_rows).select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + noise).alias("score"))
    scored = materialise(scored, "resample-scores")
    discard(weights)
    return _ranked(scored, share, least_words).select("doc_id", "n_features", "weight", "score", "rank")


def _ranked(scored: DataFrame, share: int, least_words: int) -> DataFrame:
    """scored with `rank`. Scores are few (thousandths of logarithms of numbers of bounded size: under 200,000), so that the rows before each are known first, and rows are sorted by score apart."""
    able = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    higher = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    steps = scored.where(able).groupBy("score").agg(F.count("*").alias("n")).select("score", "n", F.coalesce(F.sum("n").over(higher), F.lit(0)).alias("before"))
    n_drawn = (steps.agg(F.sum("n")).first()[0] or 0) * share // 100
    wanted = steps.where(F.col("before") < n_drawn).select("score", "before")
    rows = scored.withColumn("_able", able).join(F.broadcast(wanted), "score", "left").withColumn("_in", F.col("_able") & F.col("before").isNotNull())
    place = F.col("before") + F.row_number().over(Window.partitionBy("score").orderBy("doc_id", "n_features"))
    drawn = rows.where("_in").withColumn("rank", place).withColumn("rank", F.when(F.col("rank") <= n_drawn, F.col("rank")))
    return drawn.unionByName(rows.where("_in IS NOT TRUE").withColumn("rank", F.lit(None).cast("long")))
