"""Exact Jaccard join of word n-gram sets, and its connected components, with set-relation skipping.

Equal sets are one class from the start. Shingles are ordered by how many documents have them, rare ones first, so a pair over the
threshold shares a shingle of both prefixes; each class is listed under its prefix's shingles with its place there.

* Leaders: every class is first compared with the ends of each list it is in (smallest and largest id). Classes of a family of copies are then
  in one component, whose members needn't be compared with each other any more, and each member knows its difference from a leader.
* Block-skipping by position: a list's entries lie in blocks of one band of sizes and one band of places. Two blocks are skipped whole, before any pair
  is formed, if they are of one component, if their sizes differ too much, or if their bounds of size and place leave no room for the overlap needed.
* Derived answers: of what is left, only the leaders are intersected. The overlap of two members is that of their leaders, less at most what the
  members lack of them and plus at most what they have beyond them. Only pairs that these bounds leave open are intersected too.

No link between different texts is lost, and the pairs inside a family are never written out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm import text as tx
from quillstone.llm.common import bound_batches, chunk_count, in_chunks, materialise, ordered_texts, release_memory
from quillstone.llm.exchange import tally, values
from quillstone.llm.graph import components
from quillstone.llm.windows import named_rows


def shingle_sets(texts: list[bytes], words: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, shingle hash) pairs of many texts, in order. A text of fewer words has its whole sequence as one shingle."""
    buf, bounds = tx.joined(texts)
    if lower:
        buf = tx.lower_az(buf)
    a, b = tx.word_spans(buf)
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = tx.span_hashes(buf, a, b)
    at = np.searchsorted(a, bounds)
    count = np.diff(at)
    grams = tx.ngram_hashes(h, words)
    many = np.maximum(0, count - words + 1)
    doc, key = [np.repeat(np.arange(len(texts)), many)], [grams[tx.gather(at[:-1], many)]]
    for n in range(1, words):
        short = np.flatnonzero(count == n)
        if len(short):
            doc.append(short)
            key.append(tx.mix(tx.ngram_hashes(h, n)[at[short]] + np.uint64(n)))
    doc, key = np.concatenate(doc), np.concatenate(key)
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]))
    return doc[new], key[new]


def least_overlap(n: np.ndarray, percent: int) -> np.ndarray:
    """Shingles that a set of n shares at least with any set it links to."""
    return -(-percent * n // 100)


SETS = "doc_id long, n long, h1 long, h2 long, tokens array<long>, places array<int>"


def _prefixes(words: int, percent: int, lower: bool):
    def rows(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, texts = ordered_texts(left)
        doc, h = shingle_sets(texts, words, lower)
        n = np.bincount(doc, minlength=len(ids))
        known, at = np.unique(h, return_inverse=True)
        rarity = values(right, "u1")[at] if len(known) else np.zeros(0, np.uint8)
        total = lambda v: np.append(np.uint64(0), np.cumsum(v))
        ends = np.append(0, np.cumsum(n))
        h1, h2 = (np.diff(total(v)[ends]) for v in (tx.mix(h), tx.mix(h ^ tx.MIX1)))
        order = np.lexsort((h, rarity, doc))
        place = np.arange(len(h)) - np.repeat(ends[:-1], n)
        prefix = (n - least_overlap(n, percent) + 1)[doc]
        listed = (place < prefix) & (rarity[order] > 0)
        cuts = pa.array(np.append(0, np.cumsum(np.bincount(doc[listed], minlength=len(ids)))).astype(np.int32))
        return pa.table({
            "doc_id": pa.array(ids, pa.int64()), "n": pa.array(n.astype(np.int64)), "h1": pa.array(h1.view(np.int64)), "h2": pa.array(h2.view(np.int64)),
            "tokens": pa.ListArray.from_arrays(cuts, pa.array(h[order][listed].view(np.int64))), "places": pa.ListArray.from_arrays(cuts, pa.array(place[listed].astype(np.int32))),
        })

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = rows(left, right)
        release_memory()  # the worker is idle while the JVM does what follows
        return out

    return run


def _rarity(df: np.ndarray) -> np.ndarray:
    """0 for one document, else the number of binary digits of the count less one."""
    return np.ceil(np.log2(np.maximum(df, 1).astype(float))).astype(np.uint8)


def prefix_sets(docs: DataFrame, words: int, percent: int, lower: bool, chunk_bytes: int) -> DataFrame:
    """SETS: each document's set size, a 128-bit sum of its shingles' hashes, and the shingles of its prefix that other documents have too."""
    n_chunks = chunk_count(docs, "text", chunk_bytes)
    chunks = in_chunks(docs, n_chunks)

    def keys(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(shingle_sets(ordered_texts(table)[1], words, lower)[1], return_counts=True)

    answers = tally(chunks, keys, n_chunks, _rarity, "<u4")
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_prefixes(words, percent, lower), SETS)


def _whole_sets(words: int, lower: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                texts = [t or b"" for t in part["text"].cast(pa.binary()).to_pylist()]
                doc, h = shingle_sets(texts, words, lower)
                ends = np.append(0, np.cumsum(np.bincount(doc, minlength=len(texts))))
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array([h[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary())], names=["id", "content"])

    return run


MET = "a long, b long, both long, only_a long, only_b long"


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """MET rows: how many shingles both sets have, and each of them alone."""
    names = [x.split()[0] for x in MET.split(", ")]
    for batch in batches:
        sets = [[np.frombuffer(v.as_buffer(), np.uint64) for v in batch[c]] for c in "xy"]
        both = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(*sets, strict=True)]
        alone = [[len(v) - n for v, n in zip(side, both, strict=True)] for side in sets]
        yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], *(pa.array(v, pa.int64()) for v in (both, *alone))], names=names)
        release_memory()


def overlaps(pairs: DataFrame, content: DataFrame) -> DataFrame:
    """MET rows of the pairs (a, b), from their whole sets; an id with several sets has a row for each."""
    x = content.select(F.col("id").alias("a"), F.col("content").alias("x"))
    y = content.select(F.col("id").alias("b"), F.col("content").alias("y"))
    return pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_overlaps, MET)


def _links(percent: int) -> Column:
    return F.col("both") * 100 >= (F.col("both") + F.col("only_a") + F.col("only_b")) * percent


def derived_links(pairs: DataFrame, near: DataFrame, content: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, n_a, n_b: ids and set sizes) that link, as (a, b).

    near: MET rows of links; a class's leader is the smallest id that it links with there. Leaders are intersected first. With their overlap o,
    that of a and b lies between o less what a and b lack of their leaders and o plus what they have beyond them.
    """
    once = near.groupBy("a", "b").agg(F.count("*").alias("_n"), F.max("only_a").alias("lacks"), F.max("only_b").alias("beyond")).where("_n = 1")
    leader = once.groupBy(F.col("b").alias("id")).agg(F.min_by(F.struct(F.col("a").alias("leader"), "lacks", "beyond"), "a").alias("l"))
    for side in "ab":
        of = leader.select(F.col("id").alias(side), F.col("l").alias(f"l_{side}"))
        own = F.struct(F.col(side).alias("leader"), F.lit(0).cast("long").alias("lacks"), F.lit(0).cast("long").alias("beyond"))
        pairs = pairs.join(of, side, "left").withColumn(f"l_{side}", F.coalesce(f"l_{side}", own))
    low, high = F.least("l_a.leader", "l_b.leader"), F.greatest("l_a.leader", "l_b.leader")
    pairs = materialise(pairs.withColumns({"la": low, "lb": high}), "jaccard-pairs")
    met = overlaps(pairs.select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct(), content).withColumn("links", _links(percent))
    met = met.groupBy(F.col("a").alias("la"), F.col("b").alias("lb")).agg(F.max("both").alias("o"), F.count("*").alias("rows"), F.bool_or("links").alias("links"))
    need = F.ceil((F.col("n_a") + F.col("n_b")) * percent / F.lit(100 + percent))
    least, most = F.col("o") - F.col("l_a.lacks") - F.col("l_b.lacks"), F.col("o") + F.col("l_a.beyond") + F.col("l_b.beyond")
    themselves = (F.col("la") == F.least("a", "b")) & (F.col("lb") == F.greatest("a", "b"))
    answer = F.when(themselves, F.col("links")).when((F.col("rows") == 1) & (least >= need), True).when((F.col("rows") == 1) & (most < need), False)
    known = materialise(pairs.join(met, ["la", "lb"]).select("a", "b", answer.alias("links")), "jaccard-derived")
    still_open = known.where("links IS NULL").select("a", "b").distinct()
    return known.where("links").select("a", "b").unionByName(overlaps(still_open, content).where(_links(percent)).select("a", "b")).distinct()


def _may_link(n: Column, p: Column, m: Column, q: Column, percent: int) -> Column:
    """Sizes n, m and places p, q of a common shingle leave room for the overlap: o * (100 + percent) >= percent * (n + m)."""
    sizes = (F.least(n, m) * 100) >= F.greatest(n, m) * percent
    return sizes & (F.least(n - p, m - q) * (100 + percent) >= (n + m) * percent)


def _leader_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """Each class with the smallest and the largest id of every list that it is in."""
    entry = F.struct("id", "n")
    ends = lists.groupBy("token").agg(F.min(entry).alias("lo"), F.max(entry).alias("hi")).where("lo.id < hi.id")
    met = lists.join(ends, "token")
    out = None
    for end in ("lo", "hi"):
        other, n = F.col(f"{end}.id"), F.col(f"{end}.n")
        sizes = (F.least("n", n) * 100) >= F.greatest("n", n) * percent
        part = met.where((F.col("id") != other) & sizes).select(F.least("id", other).alias("a"), F.greatest("id", other).alias("b"))
        out = part if out is None else out.unionByName(part)
    return out.distinct()


#: Entries of a block of a list, about.
BLOCK = 64


def list_blocks(lists: DataFrame, percent: int) -> DataFrame:
    """Blocks of the lists with several components (column comp): token, band, main, entries, and the bounds of their sizes, places and components.

    A block holds entries of one band of sizes (linked sets lie in one band or in neighbouring ones) and one band of places, of the list's
    largest component or of others. Crowded bands are dealt into blocks of about BLOCK entries by a hash of the id; nothing is sorted.
    """
    counts = lists.groupBy("token", "comp").agg(F.count("*").alias("k"))
    mixed = counts.groupBy("token").agg(F.max(F.struct("k", "comp")).alias("top"), F.count("*").alias("comps")).where("comps > 1").select("token", F.col("top.comp").alias("_main"))
    band = F.floor(F.log("n") / F.lit(1.000001 * math.log(100 / percent))) if percent < 100 else F.col("n")
    rows = lists.join(mixed, "token").select("token", band.cast("long").alias("band"), F.floor(F.log2(F.col("place") + 1)).alias("places"), (F.col("comp") == F.col("_main")).alias("main"), F.struct("id", "n", "place", "comp").alias("e"))
    key = ["token", "band", "places", "main"]
    crowded = rows.groupBy(*key).agg(F.count("*").alias("_n")).where(F.col("_n") > BLOCK)
    dealt = rows.join(crowded, key, "left").withColumn("part", F.when(F.col("_n").isNotNull(), F.pmod(F.xxhash64("e.id"), F.ceil(F.col("_n") / F.lit(BLOCK)))).otherwise(0))
    bounds = [f("e." + c).alias(f"{c}_{k}") for c in ("n", "place", "comp") for f, k in ((F.min, "lo"), (F.max, "hi"))]
    return dealt.groupBy(*key, "part").agg(F.collect_list("e").alias("entries"), *bounds)


def _cross_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """(a, b, n_a, n_b): pairs of different components (column comp) that share a listed shingle and may link. Blocks are skipped before pairs are formed."""
    blocks = materialise(list_blocks(lists, percent).withColumn("block", F.struct("band", "places", "main", "part")), "jaccard-blocks")
    names = [c for c in blocks.columns if c not in ("token", "places", "main", "part")]
    x = blocks.select("token", F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("_band"), *(F.col(c).alias(f"x_{c}") for c in names))
    y = blocks.select("token", F.col("band").alias("_band"), *(F.col(c).alias(f"y_{c}") for c in names))
    one = (F.col("x_comp_lo") == F.col("x_comp_hi")) & (F.col("y_comp_lo") == F.col("y_comp_hi")) & (F.col("x_comp_lo") == F.col("y_comp_lo"))
    room = F.least(F.col("x_n_hi") - F.col("x_place_lo"), F.col("y_n_hi") - F.col("y_place_lo")) * (100 + percent) >= (F.col("x_n_lo") + F.col("y_n_lo")) * percent
    sizes = (F.col("x_n_hi") * 100 >= F.col("y_n_lo") * percent) & (F.col("y_n_hi") * 100 >= F.col("x_n_lo") * percent)
    met = x.join(y, ["token", "_band"]).where((F.col("x_block") <= F.col("y_block")) & ~one & room & sizes).select(F.explode("x_entries").alias("x"), F.col("y_entries"))
    may = lambda y: (F.col("x.comp") != y["comp"]) & _may_link(F.col("x.n"), F.col("x.place"), y["n"], y["place"], percent)
    met = met.select("x", F.explode(F.filter("y_entries", may)).alias("y"))  # a row for each pair that may link, none for the rest of a block
    ends = F.when(F.col("x.id") < F.col("y.id"), F.struct("x.id", F.col("y.id").alias("b"), "x.n", F.col("y.n").alias("m"))).otherwise(F.struct("y.id", F.col("x.id").alias("b"), "y.n", F.col("x.n").alias("m")))
    return met.select(ends.alias("p")).select(F.col("p.id").alias("a"), F.col("p.b"), F.col("p.n").alias("n_a"), F.col("p.m").alias("n_b")).distinct()


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80, lower: bool = True, chunk_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id that links reach, where two documents link if 100 * |both| >= percent * |either|.

    A set is the distinct `words`-word shingles of the whole text (words: runs without ASCII white space, A-Z in lower case if `lower`);
    with fewer words the whole sequence is one shingle, without words the set is empty and links with nothing. Shingles are told
    apart by 64-bit hashes. Rows with a null doc_id name no document and are left out. Rows that share a doc_id are one
    node, linked by any of its texts, and each is returned. An empty table gives an empty result; other columns are not read.
    """
    bound_batches(docs.sparkSession)
    docs = named_rows(docs)
    sets = materialise(prefix_sets(docs, words, percent, lower, chunk_bytes), "jaccard-sets")
    same = ["n", "h1", "h2"]
    classes = sets.where("n > 0").groupBy(*same).agg(F.min("doc_id").alias("class"))
    member = materialise(sets.join(classes, same, "left").withColumn("class", F.coalesce("class", "doc_id")), "jaccard-classes")
    lists = member.where("n > 0 AND doc_id = class").select(F.col("doc_id").alias("id"), "n", F.explode(F.arrays_zip("tokens", "places")).alias("t"))
    lists = lists.select("id", "n", F.col("t.tokens").alias("token"), F.col("t.places").alias("place"))
    shared = lists.groupBy("token").agg(F.min("id").alias("_lo"), F.max("id").alias("_hi")).where("_lo < _hi").select("token")
    lists = materialise(lists.join(shared, "token", "left_semi"), "jaccard-lists")
    needed = lists.select(F.col("id").alias("_needed")).distinct()
    content = docs.join(needed, docs["doc_id"] == needed["_needed"], "left_semi").mapInArrow(_whole_sets(words, lower), "id long, content binary")
    content = materialise(content, "jaccard-content")
    near = materialise(overlaps(_leader_pairs(lists, percent), content).where(_links(percent)), "jaccard-near")
    label = components(near)
    named = lists.join(label.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"), "left").select("id", "n", "token", "place", F.coalesce("comp", "id").alias("comp"))
    rest = materialise(derived_links(_cross_pairs(materialise(named, "jaccard-named"), percent), near, content, percent), "jaccard-rest")
    label = components(rest.unionByName(label.where("id != comp").select(F.col("comp").alias("a"), F.col("id").alias("b"))))
    joined = member.select("doc_id", "n", "class").join(label, F.col("class") == F.col("id"), "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("comp", "class").alias("component_id"))


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, with all their columns, whose doc_id is its component's smallest. Rows with a null doc_id stay."""
    found = jaccard_components(docs, **options).where("doc_id != component_id").select(F.col("doc_id").alias("_later"))
    return docs.join(found, docs["doc_id"] == found["_later"], "left_anti")
