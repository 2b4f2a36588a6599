"""Which tokens lie in a window that also starts in a document with a smaller id: the frame of both substring operators.

A token is a byte or a word's hash. Winnowing gives each window of `width` tokens one anchor: the place in it of the seed (`seed`
consecutive tokens) with the smallest hash, the leftmost at a tie. Equal windows have their anchor at the same place, so it's enough to
compare windows whose anchors have equal seeds. Consecutive windows of one anchor form a block: the tokens around the anchor.

1. Chunks send the seeds of their anchors to a tally, which answers whether a seed occurs in two documents; most don't.
2. Of the other anchors, chunks send their blocks, each distinct block once with its smallest document, to the bucket of its seed.
   Documents of the chunk that repeat a block of a smaller document lose all its windows, which is decided on the spot.
3. A bucket compares the blocks (see `mark` in the operators) and says which windows of a block start in a smaller document.
4. Chunks take in the answers and mark the tokens.

The texts are dealt into chunks once; a chunk's group is bounded by its bytes, a bucket gets one block for each chunk that has it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.llm import text as tx
from quillstone.llm.common import bound_batches, chunk_count, in_chunks, in_order, release_memory, texts_of
from quillstone.llm.exchange import tally, values

_SLAB = 1 << 19


@dataclass
class Windows:
    width: int
    seed: int

    def __post_init__(self) -> None:
        if not 1 <= self.seed <= self.width or self.width - self.seed >= 64:
            raise ValueError("a window has 1 to 64 places for its seed")

    @property
    def places(self) -> int:
        return self.width - self.seed + 1


@dataclass
class Tokens:
    """Tokens of a chunk: document i is tokens[bounds[i] : bounds[i + 1]]; ids ascend, so that rank orders documents (equal ids share it)."""

    ids: list[int]
    rank: np.ndarray
    tokens: np.ndarray
    bounds: np.ndarray


@dataclass
class Blocks:
    start: np.ndarray  # of the first window
    count: np.ndarray  # of windows
    anchor: np.ndarray
    seed: np.ndarray  # hash
    doc: np.ndarray


def _seeds(t: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k tokens from each start, by doubling."""
    n = len(t) - k + 1
    done, h, out, used = 1, t.astype(np.uint64) + np.uint64(1), None, 0
    if t.dtype == np.uint64:
        h = tx.mix(h)
    p = tx.powers(k + 1)
    while True:
        if k & done:
            part = h[used : used + n]
            out = part.copy() if out is None else out * p[done] + part
            used += done
        if done * 2 > k:
            return tx.mix(out)
        h = h[:-done] * p[done] + h[done:]
        done *= 2


def _leftmost_least(h: np.ndarray, w: int) -> np.ndarray:
    """For each run of w values, the place of the least (by its upper 32 bits), the leftmost at a tie."""
    m = (h >> np.uint64(32) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
    span = 1
    while span * 2 <= w:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    if span < w:
        m = np.minimum(m[: len(m) - (w - span)], m[w - span :])
    return (m & np.uint64(0xFFFFFFFF)).astype(np.int64)


def blocks_of(c: Tokens, win: Windows) -> Blocks:
    starts = [np.arange(a, max(a, b - win.width + 1)) for a, b in zip(c.bounds, c.bounds[1:])]
    at = np.concatenate([np.zeros(0, np.int64), *starts])
    anchor = np.empty(len(at), np.int64)
    seeds = np.empty(len(at), np.uint64)
    i = 0
    while i < len(at):
        j = int(np.searchsorted(at, at[i] + _SLAB))
        first = at[i]
        h = _seeds(c.tokens[first : at[j - 1] + win.width], win.seed)
        where = at[i:j] - first
        best = _leftmost_least(h, win.places)[where]
        anchor[i:j] = best + first
        seeds[i:j] = h[best]
        i = j
    new = np.ones(len(at), bool)
    new[1:] = anchor[1:] != anchor[:-1]
    run = np.flatnonzero(new)
    return Blocks(at[run], np.diff(np.append(run, len(at))), anchor[run], seeds[run], np.searchsorted(c.bounds, at[run], "right") - 1)


def _seed_counts(c: Tokens, b: Blocks) -> tuple[np.ndarray, np.ndarray]:
    """Distinct seeds, each with 1, or 2 if it occurs in two documents or more."""
    if not len(b.seed):
        return b.seed, np.zeros(0, np.uint8)
    order = np.argsort(b.seed, kind="stable")
    keys, rank = b.seed[order], c.rank[b.doc[order]]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[at], (1 + (np.minimum.reduceat(rank, at) != np.maximum.reduceat(rank, at))).astype(np.uint8)


BLOB = "bucket int, chunk long, kind int, number binary, doc binary, before binary, count binary, content binary"
_BLOB_TYPES = (pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 5)


def _blob_table(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in _BLOB_TYPES]
    return pa.table([pa.array(c, t) for c, t in zip(cols, _BLOB_TYPES, strict=True)], names=[x.split()[0] for x in BLOB.split(", ")])


def mark_windows(
    docs: DataFrame,
    win: Windows,
    tokens_of: Callable[[list[int], list[bytes]], Tokens],
    bucket_for: Callable[[Tokens, np.ndarray, np.ndarray, int], np.ndarray],
    mark: Callable[[Windows, np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray],
    token_type: str,
    finish: Callable[[pa.Table, list[bytes], Tokens, np.ndarray], pa.Table],
    schema: str | T.StructType,
    chunk_bytes: int = 4 << 20,
) -> DataFrame:
    """finish(rows, texts, tokens, covered) of each chunk of docs (doc_id, text and columns that finish uses), as rows of `schema`.

    bucket_for(tokens, anchors, seeds, n) deals anchors to n buckets by what follows them; mark(win, doc, before, count, content) gives, for
    blocks of a bucket, 64-bit masks of their windows that start in a document with a smaller id.
    """
    bound_batches(docs.sparkSession)
    n_chunks = chunk_count(docs, "text", chunk_bytes)
    n_buckets = n_chunks
    chunks = in_chunks(docs, n_chunks)

    def load(table: pa.Table) -> tuple[pa.Table, list[bytes], Tokens]:
        table = in_order(table)
        texts = texts_of(table)
        return table, texts, tokens_of(table["doc_id"].to_pylist(), texts)

    def seeds(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        _, _, c = load(table)
        return _seed_counts(c, blocks_of(c, win))  # the tally gives memory back

    def extracted(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _blob_table([])
        _, _, c = load(left)
        b, chunk = blocks_of(c, win), key[0].as_py()
        known = np.unique(b.seed)
        shared = values(right, "u1")[np.searchsorted(known, b.seed)] > 1 if len(known) else np.zeros(0, bool)
        start, count, anchor, doc, seed = b.start[shared], b.count[shared], b.anchor[shared], b.doc[shared], b.seed[shared]
        if not len(start):
            return _blob_table([])
        size = count - 1 + win.width
        if c.tokens.dtype == np.uint8:
            content = tx.span_hashes(c.tokens, start, start + size)
        else:
            place = tx.mix(tx.gather(np.zeros(len(size), np.int64), size).astype(np.uint64))
            content = np.add.reduceat(tx.mix(c.tokens[tx.gather(start, size)] + place) * (place | np.uint64(1)), np.cumsum(size) - size)
        content = tx.mix(content + (size * 256 + (anchor - start)).astype(np.uint64))
        rank = c.rank[doc]
        order = np.lexsort((rank, content))
        head = np.flatnonzero(np.append(True, content[order][1:] != content[order][:-1]))
        group = np.empty(len(order), np.int64)
        group[order] = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(order))))
        first = order[head]  # the block of the smallest document
        full = rank > rank[first][group]
        rows = [(-1 - chunk, chunk, 0, group.astype("<u4").tobytes(), start.astype("<u4").tobytes(), full.astype("u1").tobytes(), count.astype("u1").tobytes(), b"")]
        bucket = bucket_for(c, anchor[first], seed[first], n_buckets)
        by = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.append(True, bucket[by][1:] != bucket[by][:-1]))
        ids = np.asarray(c.ids, np.int64)
        for lo, hi in zip(cuts, np.append(cuts[1:], len(by))):
            n = by[lo:hi]
            f = first[n]
            rows.append((int(bucket[n[0]]), chunk, 1, n.astype("<u4").tobytes(), ids[doc[f]].astype("<i8").tobytes(), (anchor - start)[f].astype("u1").tobytes(), count[f].astype("u1").tobytes(), pa.compress(c.tokens[tx.gather(start[f], size[f])].astype(token_type).tobytes(), "zstd", asbytes=True)))
        return _blob_table(rows)

    def resolved_rows(table: pa.Table) -> pa.Table:
        if table["kind"][0].as_py() == 0:
            return table.drop_columns(["bucket"])
        col = lambda name, kind: [np.frombuffer(x, kind) for x in table[name].to_pylist()]
        number, doc, before, count = (col(*x) for x in (("number", "<u4"), ("doc", "<i8"), ("before", "u1"), ("count", "u1")))
        tokens = [int(c.sum(dtype=np.int64)) + len(c) * (win.width - 1) for c in count]
        packed = zip(table["content"].to_pylist(), tokens, strict=True)
        content = [np.frombuffer(pa.decompress(x, n * np.dtype(token_type).itemsize, "zstd", asbytes=True), token_type) for x, n in packed]
        masks = mark(win, np.concatenate(doc), np.concatenate(before).astype(np.int64), np.concatenate(count).astype(np.int64), np.concatenate(content))
        out, at = [], 0
        for chunk, n in zip(table["chunk"].to_pylist(), number):
            m = masks[at : at + len(n)]
            at += len(n)
            some = m > 0
            if some.any():
                out.append((0, chunk, 1, n[some].tobytes(), b"", b"", b"", m[some].astype("<u8").tobytes()))
        return _blob_table(out).drop_columns(["bucket"])

    def covered(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        rows, texts, c = load(left)
        diff = np.zeros(len(c.tokens) + 1, np.int64)
        masks = {}
        occurrences = None
        for row in right.to_pylist():
            if row["kind"] == 0:
                occurrences = [np.frombuffer(row[k], t).astype(np.int64) for k, t in (("number", "<u4"), ("doc", "<u4"), ("before", "u1"), ("count", "u1"))]
            else:
                masks[len(masks)] = np.frombuffer(row["number"], "<u4"), np.frombuffer(row["content"], "<u8")
        if occurrences is not None:
            group, start, full, count = occurrences
            by_group = np.zeros(int(group.max()) + 1, np.uint64)
            for number, mask in masks.values():
                by_group[number] = mask
            all_windows = full == 1
            np.add.at(diff, start[all_windows], 1)
            np.add.at(diff, (start + count - 1 + win.width)[all_windows], -1)
            rest = ~all_windows & (by_group[group] > 0)
            mask, start = by_group[group][rest], start[rest]
            for j in range(win.places):
                s = start[(mask >> np.uint64(j) & np.uint64(1)) == 1] + j
                np.add.at(diff, s, 1)
                np.add.at(diff, s + win.width, -1)
        return finish(rows, texts, c, np.cumsum(diff[:-1]) > 0)

    def extract(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = extracted(key, left, right)
        release_memory()
        return out

    def resolve(table: pa.Table) -> pa.Table:
        out = resolved_rows(table)
        release_memory()
        return out

    def cover(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = covered(key, left, right)
        release_memory()
        return out

    answers = tally(chunks, seeds, n_buckets, lambda total: np.minimum(total, 2).astype(np.uint8), "<u4")
    grouped = chunks.groupBy("chunk")
    blobs = grouped.cogroup(answers.groupBy("chunk")).applyInArrow(extract, BLOB)
    resolved = blobs.groupBy("bucket").applyInArrow(resolve, BLOB.removeprefix("bucket int, "))
    return grouped.cogroup(resolved.groupBy("chunk")).applyInArrow(cover, schema)


def padded(content: np.ndarray, starts: np.ndarray, lens: np.ndarray, width: int) -> np.ndarray:
    """Rows content[start : start + len], padded with zeros to `width`."""
    out = np.zeros((len(starts), width), content.dtype)
    lens = np.minimum(lens, width)
    out[np.repeat(np.arange(len(starts)), lens), tx.gather(np.zeros(len(lens), np.int64), lens)] = content[tx.gather(starts, lens)]
    return out


def masks_by_class(win: Windows, doc: np.ndarray, before: np.ndarray, count: np.ndarray, right: Callable[[int], np.ndarray], left: Callable[[int], np.ndarray]) -> np.ndarray:
    """Masks of the windows that start in a smaller document, from the classes of equal tokens right and left of the anchor.

    For each number d of tokens before the anchor, blocks that have that window are grouped by right(d) and left(d); a group's windows are
    equal, and those of documents above its smallest one are marked.
    """
    masks = np.zeros(len(doc), np.uint64)
    for d in range(win.places):
        has = np.flatnonzero((before >= d) & (before - count < d))
        if len(has) < 2:
            continue
        key = right(d)[has].astype(np.int64) * len(doc) + left(d)[has]
        order = np.lexsort((doc[has], key))
        k, who = key[order], has[order]
        head = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        least = np.repeat(doc[who[head]], np.diff(np.append(head, len(who))))
        hit = who[doc[who] > least]
        masks[hit] |= np.uint64(1) << (before[hit] - d).astype(np.uint64)
    return masks


def named_rows(docs: DataFrame, rest: str | None = None) -> DataFrame:
    """doc_id and text, and all other columns as a struct `rest` if it's named; without rows whose id is null: those name no document."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")] if rest else []
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *([F.struct(*others).alias(rest)] if others else []))
    return named.where("doc_id IS NOT NULL")
