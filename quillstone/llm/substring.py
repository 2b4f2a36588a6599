"""Substring dedup on words: seed and extend.

Documents meet on winnowed anchors (see windows.py): seeds of a few words. From each shared seed, equal words are followed to the right and to
the left, one word at a step, by splitting the classes of blocks that were equal so far; windows that stay equal to one of a smaller document
over the length threshold are removed, and adjoining windows make up the maximal repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.llm import text as tx
from quillstone.llm.windows import Tokens, Windows, mark_windows, masks_by_class, named_rows, padded

SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def word_tokens(ids: list[int], texts: list[bytes]) -> Tokens:
    buf, ends = tx.joined(texts)
    a, b = tx.word_spans(buf)
    tokens = tx.span_hashes(buf, a, b) if len(a) else np.zeros(0, np.uint64)
    return Tokens(ids, np.unique(np.asarray(ids, np.int64), return_inverse=True)[1], tokens, np.searchsorted(a, ends))


def _extend(classes: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Classes split by one more token."""
    order = np.lexsort((tokens, classes))
    k, t = classes[order], tokens[order]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(np.append(0, (k[1:] != k[:-1]) | (t[1:] != t[:-1])))
    return out


def mark_extended(win: Windows, doc: np.ndarray, before: np.ndarray, count: np.ndarray, content: np.ndarray) -> np.ndarray:
    size = count - 1 + win.width
    start = np.cumsum(size) - size
    right = padded(content, start + before, size - before, win.width)
    left = padded(content[::-1], len(content) - start - before, before, max(1, win.places - 1))
    seeds = np.zeros(len(doc), np.int64)
    for i in range(win.seed):
        seeds = _extend(seeds, right[:, i])
    rights, lefts = {0: seeds}, {0: seeds}
    for i in range(win.places - 1):
        rights[i + 1] = _extend(rights[i], right[:, win.seed + i])
        lefts[i + 1] = _extend(lefts[i], left[:, i])
    return masks_by_class(win, doc, before, count, lambda d: rights[win.places - 1 - d], lefts.__getitem__)


def _seed_bucket(c: Tokens, anchors: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    return (tx.mix(seeds) >> np.uint64(32)).astype(np.int64) * n >> 32


def _kept_words(texts: list[bytes], c: Tokens, covered: np.ndarray) -> list[bytes]:
    """Of each document, the words that aren't covered, joined by one space."""
    buf, _ = tx.joined(texts)
    flat = np.where(tx.blanks(buf), np.uint8(32), buf)
    a, b = tx.word_spans(buf)
    keep = ~covered
    text = flat[tx.gather(a[keep], (b - a)[keep] + 1)].tobytes()
    ends = np.append(0, np.cumsum((b - a)[keep] + 1))
    cuts = ends[np.append(0, np.cumsum(keep))[c.bounds]]
    return [text[i : max(i, j - 1)] for i, j in zip(cuts, cuts[1:])]


def _digest(rows: pa.Table, texts: list[bytes], c: Tokens, covered: np.ndarray) -> pa.Table:
    kept = _kept_words(texts, c, covered)
    gone = np.append(0, np.cumsum(covered))[c.bounds]
    return pa.table({"doc_id": rows["doc_id"], "n_words": pa.array(np.diff(c.bounds)), "n_removed": pa.array(np.diff(gone)), "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept])})


def _lean(rows: pa.Table, texts: list[bytes], c: Tokens, covered: np.ndarray) -> pa.Table:
    """Rows with texts as they were where nothing goes, else their kept words (a null text becomes empty)."""
    gone = np.diff(np.append(0, np.cumsum(covered))[c.bounds])
    kept = _kept_words(texts, c, covered)
    out = [(k if g else t).decode() for k, g, t in zip(kept, gone, texts, strict=True)]
    rest = {c: rows[c] for c in rows.column_names if c == "rest"}
    return pa.table({"doc_id": rows["doc_id"], "text": pa.array(out, pa.string()), "n_removed": pa.array(gone)} | rest)


def _windows(width: int) -> Windows:
    return Windows(width, max(1, (2 * width) // 5, width - 63))


def removal_digests(docs: DataFrame, width: int = 13) -> DataFrame:
    """SCHEMA: each document's words, those removed, and the SHA-256 of the words kept, joined by one space.

    A word goes if it's covered by `width` consecutive words that also start in a document with a smaller doc_id, as the input stands. Words
    are runs without ASCII white space, told apart by 64-bit hashes. Rows with a null doc_id name no document and are left out; a null
    text has no words. Rows that repeat a doc_id don't lose words to each other. Texts may have any length, an empty table gives an
    empty result, and other columns are not read.
    """
    return mark_windows(named_rows(docs), _windows(width), word_tokens, _seed_bucket, mark_extended, "<u8", _digest, SCHEMA)


def remove_repeats(docs: DataFrame, width: int = 50) -> DataFrame:
    """The rows of docs, in its columns, without their repeated words as in removal_digests, and n_chars to match.

    What is kept of a text is joined by single spaces; texts that lose nothing stay as they are, one that is all repeats becomes empty. Rows
    with a null doc_id stay as they are. Other columns may have any names.
    """
    typed = docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")})
    rows = named_rows(typed, "rest")
    schema = T.StructType([*rows.schema.fields[:2], T.StructField("n_removed", T.LongType()), *rows.schema.fields[2:]])
    lean = mark_windows(rows, _windows(width), word_tokens, _seed_bucket, mark_extended, "<u8", _lean, schema)
    columns = {c: F.col(c) if c in ("doc_id", "text") else F.col("rest").getField(c) for c in docs.columns}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(columns["n_chars"])
    return lean.select(*(v.alias(c) for c, v in columns.items())).unionByName(typed.where("doc_id IS NULL"))
