"""Exact top-k search among binary codes by incremental multi-index hashing.

A 64-bit code is cut into segments, each with an index of its own. Their number follows from the number of distinct codes: it is the one whose
probes and candidates would be fewest among random codes, so segments have a little less than log2(n) bits for n codes. A code that no index gives at radius r differs from the query by more than r bits in every segment. So all indexes are probed
at radius 0, 1, 2, ..., the larger ones in half of the segments at a time; candidates are verified on whole codes, and a query is done once its
kth verified distance lies inside what is covered: segments * r, and the segments probed at r, less one. Until then candidates beyond its kth
verified distance so far are dropped where they are met, as they can't be among the k. At the full width of a segment every code
has been met, so each query ends by the index.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.common import discard, materialise, partitions

BITS = 64
_SALTS = 16


def sign_code(vector: Column) -> Column:
    """64 sign bits of a vector of at most 64 numbers, more are an error; a missing number counts as negative. Null for a null vector."""
    bit = F.transform(vector, lambda x, i: F.when(F.coalesce(x >= 0, F.lit(False)), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    code = F.aggregate(bit, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    return F.when(F.size(vector) > BITS, F.raise_error(F.lit(f"a code has {BITS} bits")).cast("long")).otherwise(code)


def _smallest_ids(codes: DataFrame, k: int) -> DataFrame:
    """(code, id) with the k smallest ids of each code; a common code is first cut down in salted parts."""
    part = Window.partitionBy("code", "salt").orderBy("id")
    whole = Window.partitionBy("code").orderBy("id")
    salted = codes.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(_SALTS)))
    few = salted.withColumn("_n", F.row_number().over(part)).where(F.col("_n") <= k)
    return few.withColumn("_n", F.row_number().over(whole)).where(F.col("_n") <= k).select("code", "id")


def segment_count(codes: int, k: int = 10) -> int:
    """The number of segments, 2 to 16, with the fewest probes and candidates for a query among `codes` random codes, up to the radius that its kth distance needs."""
    near, total = 0, 1
    while near < BITS and total * codes < k << BITS:
        near += 1
        total += math.comb(BITS, near)

    def cost(count: int) -> float:
        widths, out = [(i + 1) * BITS // count - i * BITS // count for i in range(count)], 0.0
        for r, some in _steps(count):
            out += sum(math.comb(widths[i], r) * (1 + codes / 2 ** widths[i]) for i in some)
            if count * r + some.stop - 1 >= near:
                break
        return out

    return min(range(2, 17), key=cost)


def _segments(code: Column, count: int, some: range | None = None) -> Column:
    """array<struct<seg,width,value>>: all or some segments of a code, whose widths differ by one bit at most."""
    cuts = [i * BITS // count for i in range(count + 1)]
    part = lambda a, b: F.shiftrightunsigned(code, a).bitwiseAND(F.lit((1 << (b - a)) - 1))
    return F.array(*(F.struct(F.lit(i).alias("seg"), F.lit(cuts[i + 1] - cuts[i]).alias("width"), part(cuts[i], cuts[i + 1]).alias("value")) for i in some or range(count)))


def _steps(count: int) -> list[tuple[int, range]]:
    """Radii and the segments that are probed at them, in order."""
    half = -(-count // 2)
    return [(r, some) for r in range(-(-BITS // count) + 1) for some in ([range(count)] if r < 2 else [range(half), range(half, count)])]


def _probes(queries: DataFrame, count: int, r: int, some: range | None = None) -> DataFrame:
    """(query, seg, value) and the other columns of queries: all values that differ by r bits from one of the segments of a query.

    Bits are flipped from the lowest to the highest, one generated row for each, leaving room for those that are still to come.
    """
    spread = queries.repartition(partitions(queries.sparkSession), "query")
    own = queries.columns
    rows = spread.select(*own, F.inline(_segments(F.col("query"), count, some)), F.lit(0).alias("_from"))
    for left in range(r, 0, -1):
        places = F.when(F.col("_from") + left <= F.col("width"), F.sequence("_from", F.col("width") - left)).otherwise(F.array().cast("array<int>"))
        rows = rows.select(*own, "seg", "width", "value", F.explode(places).alias("_bit"))
        flipped = F.col("value").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_bit")))
        rows = rows.select(*own, "seg", "width", flipped.alias("value"), (F.col("_bit") + 1).alias("_from"))
    return rows.select(*own, "seg", "value")


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _met_first(query: Column, code: Column, seg: Column, count: int, r: int) -> Column:
    """True for one meeting of a query and a code: at their smallest radius, in the first segment that has it. So no meeting need be made distinct."""
    cuts = [i * BITS // count for i in range(count + 1)]
    out = F.lit(True)
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        bits = F.bit_count(F.shiftrightunsigned(query.bitwiseXOR(code), a).bitwiseAND(F.lit((1 << (b - a)) - 1)))
        out = out & F.when(F.lit(i) < seg, bits > r).otherwise(bits >= r)
    return out


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query code among found (query, id, distance), with their rank; ties go to smaller ids."""
    order = Window.partitionBy("query").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, rounds: list[tuple[int, int, int]] | None = None) -> DataFrame:
    """query_id, rank, id, distance: for each row of queries (id, code) the k rows of vectors (id, code) at the smallest Hamming distance.

    Exact: ties go to smaller ids, and fewer than k rows give them all. Equal codes are searched once and hold k ids at most. Rows
    with a null id or code are left out; a repeated id of a code counts once. No vectors or no queries give no rows. Other columns are not read. `rounds` receives
    (radius, distance covered, query codes still open) of each round.
    """
    rows = vectors.select("id", "code").where("id IS NOT NULL AND code IS NOT NULL").distinct()
    asked = queries.select(F.col("id").alias("query_id"), F.col("code").alias("query")).where("query_id IS NOT NULL AND query IS NOT NULL")
    ids = _smallest_ids(rows, k).groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids"))  # k ids at most
    ids = materialise(ids, "codes")
    codes, need = ids.agg(F.count("*"), F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()
    need, count = min(need, k), segment_count(codes, k)
    index = materialise(ids.select("code", "ids", F.inline(_segments(F.col("code"), count))).select("seg", "value", "code", "ids"), "segments")
    left = materialise(asked.select("query").distinct().withColumn("worst", F.lit(BITS)), "queries")
    found, parts = None, []
    for r, some in _steps(count):
        waiting = left.count() if need else 0
        covered = count * r + some.stop - 1
        if rounds is not None and waiting:
            rounds.append((r, covered, waiting))
        if not waiting:
            break
        first, distance = _met_first(F.col("query"), F.col("code"), F.col("seg"), count, r), _distance(F.col("query"), F.col("code"))
        met = _probes(left, count, r, some).join(index.hint("merge"), ["seg", "value"]).where(first & (distance <= F.col("worst")))
        hits = met.select("query", F.explode("ids").alias("id"), distance.alias("distance"))
        before = found
        if before is not None:
            hits = hits.unionByName(before.join(left, "query", "left_semi").select("query", "id", "distance"))
        found = materialise(_best(hits, k), "found")
        done = found.where((F.col("rank") == need) & (F.col("distance") <= covered)).select("query")
        parts.append(materialise(found.join(done, "query", "left_semi"), "done"))
        kth = found.where(F.col("rank") == need).select("query", F.col("distance").alias("_kth"))
        rest = left.join(done, "query", "left_anti").join(kth, "query", "left")
        last, left = left, materialise(rest.select("query", F.coalesce("_kth", "worst").alias("worst")), "queries")
        discard(before, last)
    discard(index, found)
    best = ids.select(F.col("code").alias("query"), F.explode("ids").alias("id"), F.lit(0).alias("distance"), F.lit(0).alias("rank")).limit(0)
    for part in parts:
        best = best.unionByName(part.select("query", "id", "distance", "rank"))
    return asked.join(best, "query").select("query_id", "rank", "id", "distance")
