"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import discard, materialise


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: a node's larger neighbours are tied to the least of it and its neighbours; small: so are its smaller ones, and the node itself."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).withColumn("m", F.least("u", "m"))
    met = both.join(least, F.col("a") == F.col("u"))
    out = met.where("b > a").select(F.col("m").alias("a"), "b") if large else met.select(F.col("m").alias("a"), "b").unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
    return out.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, comp) of every node of edges (a, b): comp is the smallest id of its component.

    Each step is two shuffles on a node's id with a partial minimum; results of a round are written to the shared folder. The number of rounds
    grows with the logarithm of the component sizes. Null ends and loops are ignored; no edges give no rows.
    """
    now = edges.where("a IS NOT NULL AND b IS NOT NULL AND a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    now = materialise(now, "edges")
    before = _state(now)
    while before[0]:
        last, now = now, materialise(_star(_star(now, large=True), large=False), "edges")
        discard(last)
        after = _state(now)
        if after == before:
            break
        before = after
    label = now.select(F.col("b").alias("id"), F.col("a").alias("comp"))
    return label.unionByName(now.select(F.col("a").alias("id"), F.col("a").alias("comp")).distinct())
