"""Pseudonymisation of batches whose documents stay rows.

Batches of few documents and characters meet in one shuffle and are done one after another as a task's rows pass. Of larger batches, a document sends the surfaces of its spans to its batch's dictionary once. They come back to the documents that have their first words, as rows of a
join, and one automaton finds their places there. Spans are resolved by document; numbers follow from the first place of a surface in the batch.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quillstone.functions import fixed
from quillstone.functions import text as t
from quillstone.operators import detect
from quillstone.operators.codebook import FILTER_BITS, _filter
from quillstone.sources.boundary import written

#: Words of a surface that its key covers at most, and documents whose surfaces are ranked together.
KEY_WORDS, DOCUMENTS = 3, 1024
#: Rows and characters of a batch that a task holds at once; larger ones, of any size, are spread over tasks.
HELD_ROWS, HELD_CHARS = 1024, 1 << 20
#: Rows that a task hands on at a time.
_OUT = 4096

_WORD = re.compile(r"\w+")
_PRIME = np.uint64(0x9E3779B97F4A7C15)

def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_LONG, _INT, _STRING = T.LongType(), T.IntegerType(), T.StringType()


def _lists(column: pa.Array) -> tuple[list[int], list[list]]:
    """The bounds of a column's lists (null ones are empty) and, for each field of their structs, all values one after another."""
    flat = column.flatten()
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.append(0, np.cumsum(size)).tolist(), [flat.field(i).to_pylist() for i in range(flat.type.num_fields)]


def _structs(sizes: list[int], fields: dict[str, tuple[list, pa.DataType]]) -> pa.ListArray:
    """Lists of structs of the given sizes from the fields' values."""
    cuts = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
    return pa.ListArray.from_arrays(cuts, pa.StructArray.from_arrays([pa.array(*f) for f in fields.values()], names=list(fields)))


@functools.lru_cache(1 << 16)
def _word_hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def _runs(words: list[str]) -> list[np.ndarray]:
    """Hashes of the runs of 1 to KEY_WORDS words, an array for each length."""
    one = np.fromiter(map(_word_hash, words), np.uint64, len(words))
    runs = [one]
    for n in range(1, min(KEY_WORDS, len(words))):
        last = runs[-1][: len(one) - n]
        runs.append((last ^ last >> np.uint64(29)) * _PRIME + one[n:])
    return runs


def text_keys(text: str) -> np.ndarray:
    """Keys of all surfaces that can stand in a text: its runs of words, and its other characters."""
    runs = _runs(_WORD.findall(detect.coarse(text)))
    marks = np.fromiter((_word_hash(c) for c in set(_WORD.sub("", text))), np.uint64)
    return np.unique(np.concatenate([*runs, marks])).astype(np.int64)


def surface_key(value: str) -> int:
    """The key of a surface: its first words, which are whole words wherever it stands, or the first character of one without words."""
    runs = _runs(_WORD.findall(detect.coarse(value))[:KEY_WORDS])
    return int((runs[-1][0] if len(runs[0]) else np.uint64(_word_hash(value[0]))).astype(np.int64))


def _plain(value: str) -> str:
    """One form of the surfaces that differ in case alone, where that is sure."""
    return value.lower() if value.isascii() else value


def _asked(bits: bytes):
    """The keys of a text in its batch (key XOR the batch's hash) that a filter of the dictionary's lets through."""

    @F.arrow_udf(T.ArrayType(_LONG))
    def keys(text: pa.Array, batch: pa.Array) -> pa.Array:
        known, size = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little").astype(bool), np.int64(FILTER_BITS)
        rows = []
        for x, of in zip(text.to_pylist(), batch.to_pylist(), strict=True):
            h = text_keys(x or "") ^ np.int64(of)
            rows.append(h[known[h % size] & known[(h.view(np.uint64) >> np.uint64(32)).astype(np.int64) % size]])
        cuts = np.append(0, np.cumsum([len(r) for r in rows])).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate([*rows, np.zeros(0, np.int64)])))

    return keys


@F.arrow_udf(_LONG)
def _surface_key(value: pa.Array) -> pa.Array:
    return pa.array([surface_key(x) if x else None for x in value.to_pylist()], pa.int64())


_FOUND = _struct(spans=detect.SPANS, surfaces=T.ArrayType(_struct(value=_STRING, kind=_STRING, key=_LONG)))


@F.arrow_udf(_FOUND)
def _found(text: pa.Array, detected: pa.Array) -> pa.Array:
    """A text's spans by rule and by detector, overlaps and all, and their different surfaces."""
    spans, sizes, values, kinds = [], [], [], []
    cuts, (starts, ends, names) = _lists(detected)
    for i, raw in enumerate(text.to_pylist()):
        raw, more = raw or "", range(cuts[i], cuts[i + 1])
        found = {*detect.by_rules(raw), *((starts[k], ends[k], names[k]) for k in more if 0 <= starts[k] < ends[k] <= len(raw))}
        spans.append(sorted(found))
        surfaces = {(_plain(raw[a:b]), k) for a, b, k in found}
        sizes.append(len(surfaces))
        values += [v for v, _ in surfaces]
        kinds += [k for _, k in surfaces]
    keys = [surface_key(v) for v in values]
    named = _structs(sizes, {"value": (values, pa.string()), "kind": (kinds, pa.string()), "key": (keys, pa.int64())})
    return pa.StructArray.from_arrays([detect._array(spans), named], names=["spans", "surfaces"])


@F.arrow_udf(T.ArrayType(_struct(start=_INT, end=_INT, kind=_STRING, surface=_STRING, fold=_STRING)))
def _resolved(text: pa.Array, spans: pa.Array, surfaces: pa.Array) -> pa.Array:
    """A text's spans and all places of the surfaces, resolved, each with its surface and the surface in case-folded form."""
    sizes, out, values = [], [], []
    cuts, (starts, ends, kinds) = _lists(spans)
    ahead, (names, of) = _lists(surfaces)
    for i, raw in enumerate(text.to_pylist()):
        raw, here = raw or "", range(cuts[i], cuts[i + 1])
        places = detect.occurrences(raw, set(zip(names[ahead[i] : ahead[i + 1]], of[ahead[i] : ahead[i + 1]])))
        kept = detect.resolved([*((starts[k], ends[k], kinds[k]) for k in here), *places])
        sizes.append(len(kept))
        out += kept
        values += [raw[a:b] for a, b, _ in kept]
    place = lambda i: [x[i] for x in out]
    folds = [v.casefold() for v in values]
    return _structs(sizes, {"start": (place(0), pa.int32()), "end": (place(1), pa.int32()), "kind": (place(2), pa.string()), "surface": (values, pa.string()), "fold": (folds, pa.string())})


@F.arrow_udf(_struct(text=_STRING, residual=T.ArrayType(_STRING)))
def _replaced(text: pa.Array, spans: pa.Array, tokens: pa.Array) -> pa.Array:
    """A text with each span's token in its place, and the kinds of what rules still find in it."""
    texts, left = [], []
    cuts, (starts, ends, _, _, folds) = _lists(spans)
    ahead, (keys, put) = _lists(tokens)
    for i, raw in enumerate(text.to_pylist()):
        known, out, at = dict(zip(keys[ahead[i] : ahead[i + 1]], put[ahead[i] : ahead[i + 1]])), [], 0
        for k in range(cuts[i], cuts[i + 1]):
            out += raw[at : starts[k]], known[folds[k]]
            at = ends[k]
        texts.append("".join([*out, (raw or "")[at:]]))
        left.append([k for *_, k in detect.resolved(detect.by_rules(texts[-1]))])
    return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(left, pa.list_(pa.string()))], names=["text", "residual"])


# Marked so that the optimizer doesn't run them twice where their fields are used apart.
_found, _resolved, _replaced = (f.asNondeterministic() for f in (_found, _resolved, _replaced))


def _dealt(rows: DataFrame) -> DataFrame:
    """rows by _row over all shuffle partitions: the Python work on them is more than their bytes tell."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_row")


def _with_detected(docs: DataFrame, detected: DataFrame | None) -> DataFrame:
    """batch_id, doc_index, text (null: empty) of documents, with the spans of a detector as `_detected` if there is one."""
    rows = docs.select("batch_id", "doc_index", F.coalesce("text", F.lit("")).alias("text"))
    if detected is None:
        return rows
    span = F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "kind")
    known = detected.groupBy(F.col("batch_id").alias("_b"), F.col("doc_index").alias("_d")).agg(F.collect_list(span).alias("_detected"))
    return rows.join(known, F.col("batch_id").eqNullSafe(F.col("_b")) & F.col("doc_index").eqNullSafe(F.col("_d")), "left").drop("_b", "_d")


def spans_of(docs: DataFrame, detected: DataFrame | None = None, listed: DataFrame | None = None) -> DataFrame:
    """Written table (_row, batch_id, doc_index, text, spans) of documents (batch_id, doc_index, text): spans of rules, detector and listed values of the whole batch.

    detected: (batch_id, doc_index, start, end, kind); listed: (batch_id, value), which count as OTHER_ID. A span's surface spreads to all places
    where it stands as a word in the batch, in any case; where spans overlap the strongest kind wins, then the longer, then the earlier one.
    No row holds more than a document: a surface meets the documents that have its first KEY_WORDS words; texts send what a filter of 2 MB, made of the dictionary, lets through. A null text is empty. A null
    batch_id is a batch of its own. Rows of equal batch_id and doc_index are documents of their own. Other columns are not read.
    """
    none = F.lit(None).cast(f"array<{t.SPAN}>")
    rows = _with_detected(docs, detected)
    rows = rows.withColumn("_found", _found(F.col("text"), none if detected is None else F.col("_detected")))
    found = written(rows.select(F.monotonically_increasing_id().alias("_row"), "batch_id", "doc_index", "text", "_found.*"), "found-spans")
    names = found.select("batch_id", F.inline("surfaces"))
    if listed is not None:
        values = listed.where(F.length("value") > 0).select("batch_id", "value", F.lit("OTHER_ID").alias("kind"), _surface_key(F.col("value")).alias("key"))
        names = names.unionByName(values)
    own = F.xxhash64("batch_id")
    names = names.distinct().select(F.col("batch_id").alias("_b"), "value", "kind", F.col("key").bitwiseXOR(own).alias("key"))
    keys = _asked(_filter(names.select(F.col("key").alias("gram"))).tobytes())
    asked = found.select("_row", "batch_id", F.explode(keys(F.col("text"), own)).alias("_key"))
    met = asked.join(names, F.col("batch_id").eqNullSafe(F.col("_b")) & (F.col("_key") == F.col("key"))).groupBy("_row").agg(F.collect_list(F.struct("value", "kind")).alias("_names"))
    done = _dealt(found).join(met, "_row", "left").select("_row", "batch_id", "doc_index", "text", _resolved(F.col("text"), F.col("spans"), F.col("_names")).alias("spans"))
    return written(done, "batch-spans")


def _numbered(first: DataFrame, taken: DataFrame) -> DataFrame:
    """first (batch_id, fold, kind, doc_index, start) with `n`: the rank within (batch_id, kind) by place, counted past the numbers in use (batch_id, kind, used).

    Ranks are counted in blocks of documents, and the blocks' sums before them.
    """
    block = F.floor(F.col("doc_index") / DOCUMENTS)
    rows = first.withColumn("_block", F.coalesce(block, F.lit(-(1 << 60)))).withColumn("_batch", F.struct("batch_id"))  # a struct of null joins and is grouped as a value
    inner = F.row_number().over(Window.partitionBy("_batch", "kind", "_block").orderBy("doc_index", "start"))
    sizes = rows.groupBy("_batch", "kind", "_block").agg(F.count("*").alias("_n"))
    ahead = F.coalesce(F.sum("_n").over(Window.partitionBy("_batch", "kind").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_batch", "kind", "_block", ahead.alias("_ahead"))
    ranked = rows.withColumn("_inner", inner).join(offsets, ["_batch", "kind", "_block"]).withColumn("n", F.col("_ahead") + F.col("_inner"))
    # of the numbers in use, those that leave fewer free ones below them than the rank are passed
    used = taken.select(F.struct("batch_id").alias("_batch"), "kind", (F.col("used") - F.row_number().over(Window.partitionBy("batch_id", "kind").orderBy("used"))).alias("n"))
    touched = used.select("_batch", "kind").distinct()
    plain = ranked.join(touched, ["_batch", "kind"], "left_anti").select("_batch", "kind", "fold", "n")
    both = ranked.join(touched, ["_batch", "kind"], "left_semi").select("_batch", "kind", "fold", "n", F.lit(0).alias("_used")).unionByName(used.withColumns({"fold": F.lit(None).cast("string"), "_used": F.lit(1)}))
    passed = F.sum("_used").over(Window.partitionBy("_batch", "kind").orderBy("n", "_used").rowsBetween(Window.unboundedPreceding, 0))
    moved = both.withColumn("n", F.col("n") + passed).where("_used = 0").select("_batch", "kind", "fold", "n")
    return plain.unionByName(moved).select("_batch.batch_id", "kind", "fold", "n")


_LABELS = {label: kind for kind, label in fixed.KINDS.items()}


def _numbers_in_use(docs: DataFrame) -> DataFrame:
    """batch_id, kind, used: the numbers of tokens that texts already have, written as tokens are."""
    token = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(fixed.TOKEN), F.lit(0))))
    rows = docs.where(F.contains("text", F.lit("["))).select("batch_id", token.alias("token")).distinct()
    label, digits = F.regexp_extract("token", r"^\[(.*)_[0-9]+\]$", 1), F.regexp_extract("token", r"_([0-9]+)\]$", 1)
    used = digits.try_cast("long")
    kind = F.create_map(*(F.lit(x) for pair in _LABELS.items() for x in pair))[label]
    return rows.select("batch_id", kind.alias("kind"), used.alias("used"), "token").where((F.col("used") > 0) & (F.col("token") == F.format_string("[%s_%02d]", label, used))).drop("token")


@dataclass
class Pseudonymised:
    """documents: batch_id, doc_index, text, phi_hits, residual_flags; mapping: batch_id, surface, canonical, token, kind, doc_index, start (the surface's first place)."""

    documents: DataFrame
    mapping: DataFrame


def mapping_of(spans: DataFrame) -> DataFrame:
    """The mapping of a table of spans_of, one row for each different surface of a batch.

    Surfaces that agree when case is folded share a token, of the kind of the first. A kind's numbers go up in the order of first places and skip those that the batch's texts use.
    """
    rows = spans.select("batch_id", "doc_index", F.inline("spans"))
    surfaces = rows.groupBy("batch_id", "surface", "fold").agg(F.min(F.struct("doc_index", "start", "kind")).alias("_first"))
    surfaces = written(surfaces, "surfaces")
    first = surfaces.groupBy("batch_id", "fold").agg(F.min("_first").alias("f")).select("batch_id", "fold", "f.*")
    numbers = _numbered(first, _numbers_in_use(spans))
    label = F.create_map(*(F.lit(x) for pair in fixed.KINDS.items() for x in pair))[F.col("kind")]
    tokens = numbers.select(F.col("batch_id").alias("_b"), F.col("fold").alias("canonical"), "kind", F.format_string("[%s_%02d]", label, F.col("n")).alias("token"))
    joined = surfaces.join(tokens, F.col("batch_id").eqNullSafe(F.col("_b")) & (F.col("fold") == F.col("canonical")))
    return joined.select("batch_id", "surface", "canonical", "token", "kind", F.col("_first.doc_index").alias("doc_index"), F.col("_first.start").alias("start"))


def replace_spans(spans: DataFrame, mapping: DataFrame) -> DataFrame:
    """batch_id, doc_index, text, phi_hits, residual_flags of a table of spans_of: tokens in place of spans. Counts are maps by kind."""
    tokens = mapping.select(F.col("batch_id").alias("_b"), "canonical", "token").distinct()
    asked = spans.select("_row", "batch_id", F.explode(F.array_distinct(F.transform("spans", lambda s: s["fold"]))).alias("fold"))
    met = asked.join(tokens, F.col("batch_id").eqNullSafe(F.col("_b")) & (F.col("fold") == F.col("canonical")))
    each = met.groupBy("_row").agg(F.collect_list(F.struct("fold", "token")).alias("_tokens"))
    done = _dealt(spans).join(each, "_row", "left").select("batch_id", "doc_index", "spans", _replaced(F.col("text"), F.col("spans"), F.col("_tokens")).alias("_done"))
    hits = F.transform("spans", lambda s: s["kind"])
    return done.select("batch_id", "doc_index", F.col("_done.text").alias("text"), _counts(hits).alias("phi_hits"), _counts(F.col("_done.residual")).alias("residual_flags"))


def _counts(kinds: Column) -> Column:
    tally = lambda kinds: F.map_from_entries(F.transform(F.array_sort(F.array_distinct(kinds)), lambda k: F.struct(k, F.size(F.filter(kinds, lambda x: x == k)))))
    return t.let(kinds, tally)


_ENTRY = _struct(surface=_STRING, canonical=_STRING, token=_STRING, kind=_STRING, start=_INT)
_TOKEN = re.compile(fixed.TOKEN, re.ASCII)


def _in_use(texts: list[str]) -> dict[str, set[int]]:
    """By kind, the numbers of tokens that texts already have, as _numbers_in_use."""
    used: dict[str, set[int]] = {}
    for token in {m for x in texts if "[" in x for m in _TOKEN.findall(x)}:
        label, _, digits = token[1:-1].rpartition("_")
        n = int(digits)
        if n > 0 and token == f"[{label}_{n:02d}]":
            used.setdefault(_LABELS[label], set()).add(n)
    return used


def _numbers(firsts: dict[str, tuple], used: dict[str, set[int]]) -> dict[str, tuple[str, str]]:
    """kind and token of each case-folded surface by its first place (doc_index, start, kind): as _numbered."""
    tokens, last = {}, {}
    for fold, (_, _, kind) in sorted(firsts.items(), key=lambda x: (x[1], x[0])):
        n, taken = last.get(kind, 0) + 1, used.get(kind, ())
        while n in taken:
            n += 1
        last[kind] = n
        tokens[fold] = kind, f"[{fixed.KINDS[kind]}_{n:02d}]"
    return tokens


def _one_batch(rows: list[tuple], replace: bool) -> Iterator[tuple]:
    """(batch_id, doc_index, text, kinds by count, entries of the mapping whose first place is here) of a batch's rows (batch_id, doc_index, text, whether it is a listed value, detected spans)."""
    found, names = [], set()
    for _, _, text, listed, detected in rows:
        if listed:
            names.add((text, "OTHER_ID"))
        else:
            spans = {*detect.by_rules(text), *((s["start"], s["end"], s["kind"]) for s in detected or () if 0 <= s["start"] < s["end"] <= len(text))}
            names.update((_plain(text[a:b]), kind) for a, b, kind in spans)
            found.append(spans)
    docs, find = [(d, text) for _, d, text, listed, _ in rows if not listed], detect.finder(names)
    kept = [detect.resolved([*spans, *find(text)]) for spans, (_, text) in zip(found, docs)]
    places: dict[str, tuple] = {}
    for i, ((d, text), spans) in enumerate(zip(docs, kept)):
        d = -(1 << 70) if d is None else d
        for a, b, kind in spans:
            place, surface = (d, a, kind, i), text[a:b]
            if surface not in places or place < places[surface]:
                places[surface] = place
    folds, firsts, entries = {x: x.casefold() for x in places}, {}, [[] for _ in docs]
    for surface, place in places.items():
        fold = folds[surface]
        firsts[fold] = min(firsts.get(fold, place[:3]), place[:3])
    tokens = _numbers(firsts, _in_use([text for _, text in docs]))
    for surface, (_, start, _, i) in places.items():
        kind, token = tokens[folds[surface]]
        entries[i].append((surface, folds[surface], token, kind, start))
    for (d, text), spans, own in zip(docs, kept, entries):
        out, at = [], 0
        for a, b, _ in spans if replace else ():
            out += text[at:a], tokens[folds[text[a:b]]][1]
            at = b
        yield rows[0][0], d, "".join([*out, text[at:]]) if replace else None, sorted(Counter(kind for *_, kind in spans).items()) if replace else [], own


def _held(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """rows (batch_id, text) of the batches that a task may hold, and of all others; None if there are none."""
    sizes = rows.groupBy(F.struct("batch_id").alias("_batch")).agg(F.count("*").alias("_n"), F.sum(F.length("text")).alias("_chars"))
    large = written(sizes.where((F.col("_n") > HELD_ROWS) | (F.col("_chars") > HELD_CHARS)).select("_batch"), "large-batches")
    if large.isEmpty():
        return rows, None
    keyed = rows.withColumn("_batch", F.struct("batch_id"))
    return keyed.join(large, "_batch", "left_anti").drop("_batch"), keyed.join(large, "_batch", "left_semi").drop("_batch")


def _gathered(rows: DataFrame, *then: str) -> DataFrame:
    """rows with those of a batch one after another, in the order of `then`, over all shuffle partitions."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "batch_id").sortWithinPartitions("batch_id", *then)


def _by_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of each batch, whose id is their first column."""
    rows = chain.from_iterable(zip(*(c.to_pylist() for c in b.columns)) for b in batches)
    return (list(g) for _, g in groupby(rows, itemgetter(0)))


def _done(docs: DataFrame, detected: DataFrame | None, listed: DataFrame | None, replace: bool) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """batch_id, doc_index, text, phi_hits, entries of the documents of batches that tasks hold; documents and listed values of all others. Without `replace`, text and phi_hits are empty."""
    rows = written(_with_detected(docs, detected), "documents")
    spans = F.lit(None).cast(f"array<{t.SPAN}>") if detected is None else F.col("_detected")
    rows = rows.select("batch_id", "doc_index", "text", F.lit(False).alias("_listed"), spans.alias("_detected"))
    if listed is not None:
        values = listed.where(F.length("value") > 0).select("batch_id", F.col("value").alias("text"), F.lit(True).alias("_listed"))
        rows = rows.unionByName(values, allowMissingColumns=True)
    held, large = _held(rows)
    out = T.StructType([rows.schema["batch_id"], rows.schema["doc_index"], *_struct(text=_STRING, phi_hits=T.MapType(_STRING, _INT), entries=T.ArrayType(_ENTRY))])
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[tuple] = []

        def made() -> pa.RecordBatch:
            ids, docs, texts, hits, entries = (list(c) for c in zip(*ready))
            flat, cuts = [e for x in entries for e in x], np.append(0, np.cumsum([len(x) for x in hits])).astype(np.int32)
            pairs = [h for x in hits for h in x]
            counts = pa.MapArray.from_arrays(pa.array(cuts), pa.array([k for k, _ in pairs], pa.string()), pa.array([n for _, n in pairs], pa.int32()))
            named = _structs([len(x) for x in entries], {f.name: ([e[i] for e in flat], schema.field("entries").type.value_type.field(i).type) for i, f in enumerate(_ENTRY)})
            columns = [pa.array(ids, schema.field(0).type), pa.array(docs, schema.field(1).type), pa.array(texts, pa.string()), counts, named]
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        for batch in _by_batch(batches):
            ready += _one_batch(batch, replace)
            if len(ready) >= _OUT:
                yield made()
                ready.clear()
        if ready:
            yield made()

    return _gathered(held).mapInArrow(run, out), large and large.where("NOT _listed"), large and large.where("_listed")


def _entries(done: DataFrame) -> DataFrame:
    """The mapping of what _done gives."""
    return done.select("batch_id", "doc_index", F.inline("entries")).select("batch_id", "surface", "canonical", "token", "kind", "doc_index", "start")


def _spread_spans(large: DataFrame, listed: DataFrame) -> DataFrame:
    """spans_of for the documents that _done leaves."""
    span = large.select("batch_id", "doc_index", F.inline("_detected"))
    return spans_of(large, span.distinct(), listed.select("batch_id", F.col("text").alias("value")))


def mapping(docs: DataFrame, detected: DataFrame | None = None, listed: DataFrame | None = None) -> DataFrame:
    """The mapping of pseudonymise alone."""
    done, large, values = _done(docs, detected, listed, replace=False)
    return _entries(done) if large is None else _entries(done).unionByName(mapping_of(_spread_spans(large, values)))


@F.arrow_udf(T.ArrayType(_STRING))
def _residual(text: pa.Array) -> pa.Array:
    """The kinds of what rules find in a text."""
    return pa.array([[k for *_, k in detect.resolved(detect.by_rules(x))] for x in text.to_pylist()], pa.list_(pa.string()))


_residual = _residual.asNondeterministic()


def pseudonymise(docs: DataFrame, detected: DataFrame | None = None, listed: DataFrame | None = None) -> Pseudonymised:
    """Documents (batch_id, doc_index, text) with tokens for what spans_of finds, and the mapping by which they are restored; keep it apart.

    Batches of HELD_ROWS documents and listed values and HELD_CHARS characters at most are done as a whole, in the task where a shuffle brings them together; the others by spans_of, mapping_of and replace_spans.
    """
    done, large, values = _done(docs, detected, listed, replace=True)
    done = written(done, "pseudonymised")
    documents = done.select("batch_id", "doc_index", "text", "phi_hits", _counts(_residual(F.col("text"))).alias("residual_flags"))
    if large is None:
        return Pseudonymised(documents, _entries(done))
    spans = _spread_spans(large, values)
    rest = written(mapping_of(spans), "mapping")
    return Pseudonymised(documents.unionByName(replace_spans(spans, rest)), _entries(done).unionByName(rest))


@F.arrow_udf(_STRING)
def _restored(text: pa.Array, known: pa.Array) -> pa.Array:
    token = re.compile(fixed.TOKEN)
    return pa.array([x and token.sub(lambda m, d=dict(k or ()): d.get(m[0], m[0]), x) for x, k in zip(text.to_pylist(), known.to_pylist(), strict=True)], pa.string())


def restore(docs: DataFrame, mapping: DataFrame) -> DataFrame:
    """docs (batch_id, doc_index, text) with the surfaces of a mapping for their tokens; of case variants, the one whose first place is the last counts.

    A batch of HELD_ROWS documents and HELD_CHARS characters at most, mapping included, is restored where a shuffle brings it together. Of the others
    tokens, not texts, meet the mapping. A null text stays null. Tokens that the mapping lacks stay.
    """
    given = docs.select("batch_id", "doc_index", "text", F.lit(True).alias("_doc"), F.lit(None).cast("string").alias("token"), F.lit(0).alias("start"))
    known = mapping.select("batch_id", "doc_index", F.col("surface").alias("text"), F.lit(False).alias("_doc"), "token", "start")
    held, large = _held(given.unionByName(known))
    out = T.StructType([docs.schema["batch_id"], docs.schema["doc_index"], T.StructField("text", _STRING)])
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, ready = re.compile(fixed.TOKEN), []
        made = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*ready), schema)], names=schema.names)
        for batch in _by_batch(batches):
            last: dict[str, tuple] = {}
            for _, d, surface, is_doc, of, start in batch:
                if not is_doc:
                    place = (d is not None, d or 0, start)
                    if of not in last or place > last[of][0]:
                        last[of] = place, surface
            put = lambda m, last=last: last[m[0]][1] if m[0] in last else m[0]
            ready += [(i, d, x and token.sub(put, x)) for i, d, x, is_doc, _, _ in batch if is_doc]
            if len(ready) >= _OUT:
                yield made()
                ready.clear()
        if ready:
            yield made()

    done = _gathered(held).mapInArrow(run, out)
    if large is None:
        return done
    entries = large.where("NOT _doc").select("batch_id", "doc_index", F.col("text").alias("surface"), "token", "start")
    return done.unionByName(_restored_apart(large.where("_doc"), entries))


def _restored_apart(docs: DataFrame, mapping: DataFrame) -> DataFrame:
    """restore for batches of any size."""
    rows = docs.select("batch_id", "doc_index", "text", F.struct("batch_id", "doc_index", F.xxhash64("text").alias("h")).alias("_row"))
    known = mapping.groupBy(F.col("batch_id").alias("_b"), F.col("token").alias("_t")).agg(F.max_by("surface", F.struct("doc_index", "start")).alias("surface"))
    asked = rows.select("_row", "batch_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(fixed.TOKEN), F.lit(0)))).alias("token")).distinct()
    met = asked.join(known, F.col("batch_id").eqNullSafe(F.col("_b")) & (F.col("token") == F.col("_t")))
    each = met.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("token", "surface"))).alias("_known"))
    return rows.join(each, "_row", "left").select("batch_id", "doc_index", _restored(F.col("text"), F.col("_known")).alias("text"))


def by_batch(counts: DataFrame, column: str) -> DataFrame:
    """batch_id, kind, hits: the sums over a batch's documents of a map of counts."""
    return counts.select("batch_id", F.explode(column).alias("kind", "n")).groupBy("batch_id", "kind").agg(F.sum("n").alias("hits"))
