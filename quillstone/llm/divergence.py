"""Source divergence audit: how far the word use of each source of a language is from that of its other sources and of the language.

Counting is prefiltered by a sketch. Each task keeps saturating count-min counters of how many documents of a language hold a term; merged,
they never underestimate, so that a term below the threshold in any row can't be kept and never reaches a shuffle. What is left is counted
exactly, and pairs of sources meet on the terms that both have; all other terms of a pair are told by how often counts repeat.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm import text as tx
from quillstone.llm.common import bound_batches, discard, materialise, partitions
from quillstone.llm.terms import LETTERS, encoded, term_spans, text_parts

#: Counters of a sketch's row that travel as one binary value.
_SLICE = 1 << 16
#: Bytes of text whose terms are counted at once.
_PART = 4 << 20
#: Sources of a language that one task holds against a hot term's others.
_SOURCES = 1024


class _Terms:
    """The terms of some texts: distinct ones, and the distinct (text, term) pairs with their counts."""

    def __init__(self, texts: list[bytes], part: pa.RecordBatch) -> None:
        buffer, doc, starts, ends = term_spans(texts, LETTERS)
        number, self.terms = encoded(buffer, starts, ends, LETTERS)
        del buffer, starts, ends
        self.n_terms = max(1, len(self.terms))
        pairs, self.count = np.unique(doc * self.n_terms + number, return_counts=True)
        self.doc, self.term = pairs // self.n_terms, pairs % self.n_terms
        langs = part["lang"].dictionary_encode()
        self.lang, self.langs = langs.indices.to_numpy().astype(np.int64), langs.dictionary.to_pylist()

    def keys(self, lang: np.ndarray, term: np.ndarray) -> np.ndarray:
        """64-bit keys of (language, term) pairs. Two pairs of one key are counted together by the sketch, which only raises its numbers."""
        raw = self.terms.cast(pa.binary()).to_pylist()
        buffer, bounds = tx.joined(raw)
        words = tx.span_hashes(buffer, bounds[:-1], bounds[1:] - 1) if raw else np.zeros(0, np.uint64)
        names = np.array([zlib.crc32(x.encode()) for x in self.langs], np.uint64)
        return tx.mix(words[term] + tx.mix(names[lang] + np.uint64(1)))


def _cells(keys: np.ndarray, depth: int, width: int) -> Iterator[np.ndarray]:
    for step in np.arange(1, depth + 1, dtype=np.uint64) * tx.BASE:
        yield (tx.mix(keys + step) & np.uint64(width - 1)).astype(np.int64)


def _counters(depth: int, width: int, least: int):
    """A task's counters (slice, packed), which stop at `least`; slices without a count don't travel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((depth, width), np.uint8)
        for texts, part in text_parts(batches, _PART):
            found = _Terms(texts, part)
            pair, n = np.unique(found.lang[found.doc] * found.n_terms + found.term, return_counts=True)
            keys = found.keys(pair // found.n_terms, pair % found.n_terms)
            for row, cells in enumerate(_cells(keys, depth, width)):
                order = np.argsort(cells)
                at, first = np.unique(cells[order], return_index=True)
                if len(at):
                    total[row, at] = np.minimum(total[row, at] + np.add.reduceat(n[order], first), least)
        slices = total.reshape(-1, min(width, _SLICE))
        used = np.flatnonzero(slices.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([zlib.compress(slices[i].tobytes(), 1) for i in used], pa.binary())], names=["slice", "packed"])

    return run


def _merged(least: int):
    """Of all tasks' counters of a slice: one bit each, whether the sum reaches `least`. Rows stream; a slice is one array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, packed in zip(batch["slice"].to_pylist(), batch["packed"].to_pylist(), strict=True):
                one = np.frombuffer(zlib.decompress(packed), np.uint8).astype(np.uint16)
                slices[at] = np.minimum(slices[at] + one, least) if at in slices else one
        yield pa.RecordBatch.from_arrays([pa.array(list(slices), pa.int32()), pa.array([np.packbits(s >= least).tobytes() for s in slices.values()], pa.binary())], names=["slice", "bits"])

    return run


def possible_terms(docs: DataFrame, least: int, width: int, depth: int) -> np.ndarray:
    """depth x width flags: a (language, term) whose cells aren't all set is in fewer than `least` documents. depth * width / 8 bytes come to the driver."""
    rows = docs.select("lang", "text").mapInArrow(_counters(depth, width, least), "slice int, packed binary")
    merged = rows.repartition(partitions(docs.sparkSession), "slice").mapInArrow(_merged(least), "slice int, bits binary").collect()
    size = min(width, _SLICE)
    flags = np.zeros((depth * width // size, size), bool)
    for r in merged:
        flags[r["slice"]] = np.unpackbits(np.frombuffer(r["bits"], np.uint8))[:size]
    return flags.reshape(depth, width)


COUNTED = "lang string, source string, term string, n long, docs long"


def _counted(flags: bytes, depth: int, width: int):
    """COUNTED rows of each part of the texts: what the sketch leaves, by group and term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(np.frombuffer(flags, np.uint8))[: depth * width].reshape(depth, width).astype(bool)
        for texts, part in text_parts(batches, _PART):
            found = _Terms(texts, part)
            if not len(found.doc):
                continue
            sources = part["source"].dictionary_encode()
            at, names = sources.indices.to_numpy().astype(np.int64), sources.dictionary
            pair, back = np.unique(found.lang[found.doc] * found.n_terms + found.term, return_inverse=True)
            keys = found.keys(pair // found.n_terms, pair % found.n_terms)
            good = np.logical_and.reduce([known[row, cells] for row, cells in enumerate(_cells(keys, depth, width))])[back]
            doc, term, count = found.doc[good], found.term[good], found.count[good]
            key = (found.lang[doc] * len(names) + at[doc]) * found.n_terms + term
            group, inverse = np.unique(key, return_inverse=True)
            n = np.bincount(inverse, count, len(group)).astype(np.int64)
            of, term = group // found.n_terms, group % found.n_terms
            columns = [pa.array(found.langs, pa.string()).take(of // len(names)), names.take(of % len(names)), found.terms.take(term).cast(pa.string()), pa.array(n), pa.array(np.bincount(inverse, minlength=len(group)).astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])

    return run


def term_counts(docs: DataFrame, least: int = 3, width: int = 1 << 22, depth: int = 3) -> DataFrame:
    """lang, source, term, n, total: occurrences of each term in a group and in its language, for terms in `least` documents of the language at least."""
    flags = possible_terms(docs, least, width, depth)
    raw = docs.mapInArrow(_counted(np.packbits(flags).tobytes(), depth, width), COUNTED)
    counts = materialise(raw.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total")).where(F.col("docs") >= least).select("lang", "term", "total")
    done = materialise(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "total"), "kept-terms")
    discard(counts)
    return done


def share(count: Column, total: Column, kinds: Column) -> Column:
    """1 + floor(10**9 * (count + 1) / (total + kinds)), exactly, and 1 where both are 0."""
    wide = F.lit(1_000_000_000).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)")
    below = total + kinds
    short = F.when(count < 9_000_000_000, 1 + F.call_function("div", F.lit(1_000_000_000).cast("long") * (count + 1), below))  # fits 64 bits, unlike larger counts
    return F.when(below > 0, short.otherwise(1 + F.call_function("div", wide, below.cast("decimal(20,0)")))).otherwise(F.lit(1)).cast("long")


def distance(p: Column, q: Column) -> Column:
    """floor((p - q)**2 / q) of whole shares, p and q up to 10**9 + 1."""
    return F.call_function("div", (p - q) * (p - q), q)


def _pairs(groups: DataFrame, terms: DataFrame) -> DataFrame:
    """lang, source, item, value for each source and each other source of the language.

    With p0 the share of a term that a source lacks, the sum over all V terms is V * f(p0, q0), changed for terms of either source alone and
    changed again for terms of both. The first change only depends on how often a count occurs in a source, so counts, not terms, meet the
    other sources; the second meets on terms.
    """
    hist = terms.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("k"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    alone = hist.join(other, "lang").where("source <> item")
    base = distance(F.col("p0"), F.col("q0")), distance(F.col("q0"), F.col("p0"))
    alone = alone.groupBy("lang", "source", "item").agg(
        F.sum(F.col("k") * (distance(F.col("p"), F.col("q0")) - base[0])).alias("there"), F.sum(F.col("k") * (distance(F.col("q0"), F.col("p")) - base[1])).alias("back")
    )
    parts = F.least(F.ceil(F.col("sources") / _SOURCES), F.lit(1 << 20)).cast("int")
    dealt = terms.withColumn("parts", parts)
    a = dealt.select("lang", "term", "source", "p", "p0", F.pmod(F.xxhash64("source"), F.col("parts")).cast("int").alias("part"))
    b = dealt.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("q0"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    p, q, p0, q0 = (F.col(c) for c in ("p", "q", "p0", "q0"))
    change = lambda p, p0, q, q0: distance(p, q) - distance(p, q0) - distance(p0, q) + distance(p0, q0)
    both = a.join(b, ["lang", "term", "part"]).where("source < item").groupBy("lang", "source", "item").agg(F.sum(change(p, p0, q, q0)).alias("there"), F.sum(change(q, q0, p, p0)).alias("back"))
    whole = groups.select("lang", "source", "p0", "kinds").join(other, "lang").where("source <> item").select("lang", "source", "item", (F.col("kinds").cast("decimal(38,0)") * distance(p0, q0)).alias("v"))
    way = lambda source, item, v: F.struct(F.col(source).alias("source"), F.col(item).alias("item"), F.col(v).cast("decimal(38,0)").alias("v"))
    for part in (alone, both):  # both ways of a pair come from one row
        whole = whole.unionByName(part.select("lang", F.inline(F.array(way("source", "item", "there"), way("item", "source", "back")))))
    return whole.groupBy("lang", "source", "item").agg(F.sum("v").cast("long").alias("value"))


def audit(docs: DataFrame, least: int = 3, ranks: int = 200, width: int = 1 << 22, depth: int = 3) -> DataFrame:
    """docs (text, lang, source) to lang, source, part, item, value, rank.

    Part `pair`: the divergence of a source's word use from that of each other source of its language. Part `term`: the `ranks` terms that a source
    uses most beyond its language. Terms are runs of letters and bytes beyond ASCII, A-Z in lower case, in `least` documents (rows) of the
    language at least; shares are thousand-millionths, one added to each count. `width` (a power of two) and `depth` are the sketch's size:
    they change what is shuffled, never a result. A task holds depth * width bytes, the driver and a broadcast an eighth of it.

    Null text, lang and source are ''. A group without terms has its pairs, a language without kept terms has values of 0. Repeated rows
    count as documents of their own. No rows give no rows. Other columns are not read. Sums hold for up to 10**8 kept terms a language.
    """
    if width & (width - 1) or width < 8:
        raise ValueError("width must be a power of two")
    bound_batches(docs.sparkSession)
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    counts = term_counts(rows, least, width, depth)
    langs = counts.groupBy("lang", "term").agg(F.first("total").alias("total")).groupBy("lang").agg(F.count("*").alias("kinds"), F.sum("total").alias("all"))
    sizes = counts.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    groups = rows.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["size", "kinds", "all"])
    groups = groups.withColumns({"p0": share(F.lit(0), F.col("size"), F.col("kinds")), "sources": F.count("*").over(Window.partitionBy("lang"))})
    groups = materialise(groups, "source-groups")
    shares = share(F.col("n"), F.col("size"), F.col("kinds")).alias("p"), share(F.col("total"), F.col("all"), F.col("kinds")).alias("q")
    terms = counts.join(groups, ["lang", "source"]).select("lang", "source", "term", *shares, "p0", "sources")
    terms = materialise(terms, "term-shares")  # each is read four times
    over = terms.where("p > q").select("lang", "source", F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    best = over.withColumn("rank", place).where(F.col("rank") <= ranks)
    pairs = _pairs(groups, terms).withColumn("rank", place)
    named = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return named(pairs, "pair").unionByName(named(best, "term"))
