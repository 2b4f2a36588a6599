"""Suffix-array dedup of byte strings.

Suffixes start at winnowed anchors of the texts (see windows.py): every string of `width` bytes has an anchor inside, at the same place
wherever it occurs. Splitters sampled from the suffixes' leading bytes cut them into ranges; each range is sorted on its own by
multikey quicksort, eight bytes at a step, refining only what is still equal. Splitters are compared on the leading bytes alone, so equal
beginnings never lie in two ranges and no run goes on across a boundary. Common prefixes of neighbours, right and left of the
anchor, then give the classes of equal strings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm import text as tx
from quillstone.llm.windows import Tokens, Windows, blocks_of, mark_windows, masks_by_class, named_rows, padded

SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
#: Ranges for each bucket of the shuffle.
RANGES = 1
#: Documents that the splitters are sampled from, and suffixes of each, at most.
SAMPLE_DOCS, SAMPLE_SUFFIXES = 2_000, 32
_LEAD = 16


def byte_tokens(ids: list[int], texts: list[bytes]) -> Tokens:
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=bounds[1:])
    return Tokens(ids, np.unique(np.asarray(ids, np.int64), return_inverse=True)[1], np.frombuffer(b"".join(texts), np.uint8), bounds)


def leads(tokens: np.ndarray, anchors: np.ndarray, n: int) -> np.ndarray:
    """The first n bytes of suffixes, which compare as bytes; no more than a seed's, as those are equal wherever windows are."""
    at = anchors[:, None] + np.arange(n)
    rows = tokens[at]
    return np.ascontiguousarray(rows).view(f"S{n}").ravel()


def multikey_sort(words: np.ndarray) -> np.ndarray:
    """Order of rows of unsigned words: sort by the first word, then each run of equal rows by the next, until none is left."""
    order = np.argsort(words[:, 0], kind="stable")
    run = np.cumsum(np.append(0, words[order, 0][1:] != words[order, 0][:-1]))
    for c in range(1, words.shape[1]):
        same = np.append(False, run[1:] == run[:-1])
        tied = np.flatnonzero(same | np.append(same[1:], False))
        if not len(tied):
            break
        rows = order[tied]
        sub = np.lexsort((words[rows, c], run[tied]))
        order[tied] = rows[sub]
        new = np.append(True, (run[1:] != run[:-1]))
        new[tied[1:]] |= (words[order[tied[1:]], c] != words[order[tied[:-1]], c]) & (tied[1:] == tied[:-1] + 1)
        run = np.cumsum(new) - 1
    return order


def _sorted_classes(rows: np.ndarray) -> Callable[[int], np.ndarray]:
    """classes(n): numbers of the groups of rows with equal first n bytes, from the sorted rows' common prefixes."""
    n, width = rows.shape
    full = np.zeros((n, -(-width // 8) * 8), np.uint8)
    full[:, :width] = rows
    order = multikey_sort(full.view(">u8").astype(np.uint64))
    differs = rows[order[1:]] != rows[order[:-1]]
    common = np.where(differs.any(1), differs.argmax(1), width)

    def classes(length: int) -> np.ndarray:
        out = np.empty(n, np.int64)
        out[order] = np.cumsum(np.append(0, common < length))
        return out

    return classes


def mark_sorted(win: Windows, doc: np.ndarray, before: np.ndarray, count: np.ndarray, content: np.ndarray) -> np.ndarray:
    size = count - 1 + win.width
    start = np.cumsum(size) - size
    right = _sorted_classes(padded(content, start + before, size - before, win.width))
    left = _sorted_classes(padded(content[::-1], len(content) - start - before, before, max(1, win.places)))
    return masks_by_class(win, doc, before, count, lambda d: right(win.width - d), left)


def sample_splitters(docs: DataFrame, win: Windows) -> np.ndarray:
    """Sorted leading bytes of a bounded sample of suffixes; it only balances the ranges, results don't depend on it."""
    every = max(1, docs.count() // SAMPLE_DOCS)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch["text"].cast(pa.binary()).to_pylist():
                c = byte_tokens([0], [text or b""])
                b = blocks_of(c, win)
                some = b.anchor[np.argsort(b.seed)[:SAMPLE_SUFFIXES]]
                yield pa.RecordBatch.from_arrays([pa.array(leads(c.tokens, some, min(_LEAD, win.seed)).tolist(), pa.binary())], names=["lead"])

    few = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).limit(4 * SAMPLE_DOCS)
    return np.sort(np.array(few.mapInArrow(sample, "lead binary").toArrow()["lead"].to_pylist(), f"S{_LEAD}"))


def _range_bucket(sample: np.ndarray, win: Windows) -> Callable:
    def bucket(c: Tokens, anchors: np.ndarray, _: np.ndarray, n: int) -> np.ndarray:
        cuts = np.unique(sample[np.linspace(0, len(sample) - 1, RANGES * n + 1).astype(int)[1:-1]]) if len(sample) else sample
        return np.searchsorted(cuts, leads(c.tokens, anchors, min(_LEAD, win.seed)), "right")

    return bucket


def _digest(rows: pa.Table, texts: list[bytes], c: Tokens, covered: np.ndarray) -> pa.Table:
    out = []
    for i, doc in enumerate(c.ids):
        a, b = c.bounds[i], c.bounds[i + 1]
        gone = covered[a:b]
        kept = texts[i] if not gone.any() else c.tokens[a:b][~gone].tobytes()
        spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(len(gone) > 0 and gone[0])
        out.append((doc, len(gone), len(gone) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    kinds = (*[pa.int64()] * 4, pa.string())
    return pa.table([pa.array(v, k) for v, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])


def _kept(rows: pa.Table, texts: list[bytes], c: Tokens, covered: np.ndarray) -> pa.Table:
    kept = [c.tokens[a:b][~covered[a:b]].tobytes() for a, b in zip(c.bounds, c.bounds[1:])]
    return pa.table({"doc_id": rows["doc_id"], "kept": pa.array(kept, pa.binary())})


def remove_repeats(docs: DataFrame, width: int = 50, digests: bool = False) -> DataFrame:
    """Each document without the bytes covered by a string of `width` bytes that also starts in a document with a smaller doc_id.

    doc_id and `kept` (binary: a cut may fall inside a character), or SCHEMA with digests. Strings are judged on the input. Rows with a
    null doc_id name no document and are left out; a null text is empty. Rows that repeat a doc_id don't lose bytes to each other. Texts
    may have any length and an empty table gives an empty result; other columns are not read.
    """
    win = Windows(width, max(1, width // 2 - 1))
    docs = named_rows(docs)
    bucket = _range_bucket(sample_splitters(docs, win), win)
    finish, schema = (_digest, SCHEMA) if digests else (_kept, "doc_id long, kept binary")
    return mark_windows(docs, win, byte_tokens, bucket, mark_sorted, "u1", finish, schema)
