"""Jump consistent hashing in DataFrame functions (no Python on the rows).

A key's shard among n is found by following its pseudo-random jumps 0 < j1 < j2 < ... while they stay below n. One more
shard only lengthens the walk by a jump to the new shard, so rows move into the new shard and nowhere else. No ring table.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the published jump hash: the multiplier of its 64-bit generator, and 2**64, 2**33 and 2**31.
MULTIPLIER, WORD, SHIFT, SCALE = 2862933555777941757, 2**64, 2**33, 2**31

_BIG = "decimal(38,0)"


def _word() -> Column:
    return F.lit(Decimal(WORD)).cast("decimal(20,0)")


def _step(key: Column) -> Column:
    """key * MULTIPLIER + 1 modulo 2**64 in decimals, as a long product overflows; it stays below 10**38."""
    return (key * F.lit(MULTIPLIER).cast("decimal(19,0)") + F.lit(1)).cast(_BIG) % _word()


def jump_hash(key: Column, shards: int) -> Column:
    """Shard in [0, shards) of a long key, read as unsigned. A walk makes `shards` jumps at most.

    Each jump goes at least one shard ahead, so `shards` steps suffice; about ln(shards) of them still move.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    start = key.cast("decimal(20,0)")
    start = F.when(start < 0, start + _word()).otherwise(start).cast("decimal(20,0)")
    state = F.struct(start.alias("k"), F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))

    def jump(s: Column, _: Column) -> Column:
        k = _step(s["k"]).cast("decimal(20,0)")
        top = F.floor(k / F.lit(SHIFT)).cast("long")
        j = F.floor((s["j"] + 1).cast("double") * (F.lit(float(SCALE)) / (top + 1).cast("double"))).cast("long")
        return F.when(s["j"] < shards, F.struct(k.alias("k"), s["j"].alias("b"), j.alias("j"))).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), state, jump, lambda s: s["b"].cast("int"))


def slots(rows: DataFrame, shard: str, order: list[Column], block: Column, blocks: int) -> DataFrame:
    """rows with `slot`, gapless from 0 in each shard.

    Rows are numbered in (shard, block) groups, which are small, and shifted by what earlier blocks of the shard hold;
    the table of those shifts has at most shards * blocks rows, however many rows there are.
    """
    rows = rows.withColumn("_block", block)
    sizes = rows.groupBy(shard, "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(shard).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(F.col(shard).alias("_shard"), F.col("_block").alias("_at"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    here = Window.partitionBy(shard, "_block").orderBy(*order)
    numbered = rows.withColumn("_rank", F.row_number().over(here) - 1)
    joined = numbered.join(F.broadcast(shifts), (F.col(shard) == F.col("_shard")) & (F.col("_block") == F.col("_at")))
    return joined.withColumn("slot", (F.col("_rank") + F.col("_shift")).cast("long")).drop("_block", "_n", "_rank", "_shift", "_shard", "_at")


def shard_documents(docs: DataFrame, shards: int = 16, blocks: int = 1024) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law ('key'), shard, slot, grown_shard.

    size: UTF-8 bytes of the text plus 1. Only doc_id and the shard count decide. Nulls: a null text counts as empty, a null
    doc_id as key 0. Repeated rows each get a slot of their own; an empty table gives an empty result; other columns
    of docs are not read, so their names can't clash. The table of shifts that is broadcast has shards * blocks rows at most.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
    )
    key = F.coalesce(F.col("doc_id"), F.lit(0).cast("long"))
    rows = rows.withColumns({"law": F.lit("key"), "shard": jump_hash(key, shards), "grown_shard": jump_hash(key, shards + 1)})
    out = slots(rows, "shard", [F.col("doc_id"), F.col("text_crc32"), F.col("size")], F.pmod(F.xxhash64(key, "text_crc32"), F.lit(blocks)), blocks)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def jump_hash_python(key: int, shards: int) -> int:
    """The same walk for one key, for tests and for callers on the driver."""
    k, b, j = key % WORD, -1, 0
    while j < shards:
        b = j
        k = (k * MULTIPLIER + 1) % WORD
        j = int((b + 1) * (float(SCALE) / float((k >> 33) + 1)))
    return b
