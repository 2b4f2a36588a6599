"""Packing by power-of-two decomposition.

A document of n tokens is cut into n // longest pieces of the longest length and one piece for each binary digit of the
rest, so every piece has a power-of-two length and is a sequence of its own: no sequence crosses documents and none is
padded. Training takes batches from one length bucket at a time (`length` is the bucket).
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm import text as tx
from quillstone.llm.common import bound_batches, in_parts

LONGEST, END_ID = 4096, 2

#: A word of plain letters (ASCII, Latin-1), which stay letters when they're composed and put in lower case, and a run of ASCII marks after them.
_PLAIN = re.compile("([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([!-&(-/:-@[-`{-~]*)")


class Encoder:
    """Token ids of many texts at once, by way of their distinct words.

    The vocabulary's pre-tokenizer drops white space and never joins what it separates, and its normalizer (composition,
    lower case) doesn't look across it, so a text's ids are its words' ids one after another. It also cuts between letters and marks,
    so plain words are encoded by their letters, many in one call: each run of letters ends with a token that ends a word. The ids of
    letters and marks are kept for later texts, in tables that are emptied when they hold more than `most` entries. Words of a
    batch are made distinct by 64-bit hashes, whose equality is checked byte by byte.
    """

    def __init__(self, path: str, most: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.light = Tokenizer.from_file(path)  # for runs of lower-case letters between spaces, which its own rules leave as they are
        self.light.normalizer = normalizers.Sequence([])
        self.light.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.letters: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {"": b""}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _alone(self, words: list[str]) -> list[bytes]:
        parts = (words[i : i + 4096] for i in range(0, len(words), 4096))
        return [np.asarray(e.ids, "<u4").tobytes() for part in parts for e in self.tokenizer.encode_batch(part, add_special_tokens=False)]

    def _learn_letters(self, runs: set[str]) -> None:
        new = runs - self.letters.keys()
        if len(self.letters) + len(new) > self.most:
            self.letters.clear()
            new = runs
        new = list(new)
        groups = [new[i : i + 512] for i in range(0, len(new), 512)]
        for group, e in zip(groups, self.light.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.asarray(e.ids, "<u4")
            cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            raw = ids.tobytes()
            self.letters.update(zip(group, (raw[a:b] for a, b in zip([0, *cuts], cuts, strict=False)), strict=True))

    def _learn_marks(self, runs: set[str]) -> None:
        new = runs - self.marks.keys()
        if len(self.marks) + len(new) > self.most:
            self.marks = {"": b""}
            new = runs - {""}
        self.marks.update(zip(new, self._alone(list(new)), strict=True))

    def words(self, words: list[str]) -> list[bytes]:
        """Ids, little-endian unsigned 32-bit, of each word."""
        plain = [m.groups() if m else None for m in map(_PLAIN.fullmatch, words)]
        runs = [p[0].lower() if p else "" for p in plain]
        self._learn_letters({r for r in runs if r})
        self._learn_marks({p[1] for p in plain if p})
        other = iter(self._alone([w for w, p in zip(words, plain, strict=True) if not p]))
        letters, marks = self.letters, self.marks
        return [letters[r] + marks[p[1]] if p else next(other) for r, p in zip(runs, plain, strict=True)]

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of UTF-8 texts."""
        buf, bounds = tx.joined(texts)
        a, b = tx.word_spans(buf)
        if not len(a):
            return [np.zeros(0, "<u4")] * len(texts)
        raw, lens = buf.tobytes(), b - a
        _, first, at = np.unique(tx.span_hashes(buf, a, b), return_index=True, return_inverse=True)
        if not (np.array_equal(lens, lens[first][at]) and tx.same_bytes(buf, a, a[first][at], lens)):
            place: dict[bytes, int] = {}  # two words of one hash
            at = np.array([place.setdefault(raw[i:j], len(place)) for i, j in zip(a.tolist(), b.tolist())])
            first = np.unique(at, return_index=True)[1]
        known = self.words([raw[i:j].decode() for i, j in zip(a[first].tolist(), b[first].tolist())])
        pool = np.frombuffer(b"".join(known), "<u4")
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        each = size[at]
        ids = pool[tx.gather((np.cumsum(size) - size)[at], each)]
        cuts = np.append(0, np.cumsum(each))[np.searchsorted(a, bounds)]
        return [ids[i:j] for i, j in zip(cuts, cuts[1:])]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each file and Python process, kept from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def lengths(n: int, longest: int = LONGEST) -> list[int]:
    """The lengths of the pieces of n tokens, longest first."""
    return [longest] * (n // longest) + [1 << i for i in range(longest.bit_length() - 2, -1, -1) if n % longest >> i & 1]


def _pack(path: str, end_id: int | None, longest: int, with_ids: bool) -> Callable:
    end = b"" if end_id is None else np.uint32(end_id).astype("<u4").tobytes()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])]

    def rows(doc: int | None, raw: bytes) -> Iterator[tuple]:
        start, total = 0, len(raw) // 4
        for n in lengths(total, longest):
            yield doc, start, n, zlib.crc32(raw[4 * start : 4 * (start + n)]), total
            start += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, texts, _ in in_parts(batches, 4 << 20):
            raws = [ids.tobytes() + end for ids in encoder(path).encode(texts)]
            out = [r for doc, raw in zip(docs, raws, strict=True) for r in rows(doc, raw)]
            if out:
                columns = [pa.array(v, pa.int64()) for v in zip(*out, strict=True)]
                if with_ids:  # pieces lie in the order of the documents' ids
                    cuts = np.append(0, np.cumsum([r[2] for r in out])).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.frombuffer(b"".join(raws), "<i4"))))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def pack(docs: DataFrame, tokenizer_path: str, end_id: int | None = END_ID, longest: int = LONGEST, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and `ids` if asked for.

    Each piece is one sequence (offset 0) and its length, a power of two up to `longest`, is its bucket. One pass over the
    documents, no shuffle: sequence_id is unique, made from the partition and the place in it. The tokenizer's file must be
    at tokenizer_path on every executor. A null text is empty; with end_id every document has one piece at least, without it
    an empty one has none. A null doc_id stays null. Repeated rows are packed once each. Other columns are not read.
    """
    if longest & (longest - 1) or longest < 1:
        raise ValueError("longest must be a power of two")
    bound_batches(docs.sparkSession)
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + (", ids array<int>" if with_ids else "")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = rows.mapInArrow(_pack(tokenizer_path, end_id, longest, with_ids), schema)
    return pieces.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
