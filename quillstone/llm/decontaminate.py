"""Benchmark decontamination by pigeonhole edit matching.

With at most k errors, one of k + 1 pieces of a test item occurs unchanged. An Aho-Corasick automaton finds all piece hits in a
document in one pass; each hit gives a window in which the item would lie, and Myers' bit-parallel algorithm finds the smallest edit
distance of the item to any part of that window. Both sides are compared as lower-case words joined by single spaces, and an item has
the edges of its first and last word as characters of their own: one that stands inside longer words has an error at each such edge.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import bound_batches, materialise, release_memory

#: Errors allowed: this share of an item's characters, rounded down.
ERROR_RATE = 0.08
#: Characters of test items in one automaton; more items than that are matched in blocks, one pass over the documents each.
BLOCK_CHARS = 2_000_000

MATCHES = "doc_id long, item_id long, errors int, allowed int, end long"
_WORD = re.compile(r"\w+")
_SPACELESS = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")


def normal(text: str) -> str:
    return " ".join(_WORD.findall(text.lower()))


def edge(c: str) -> str:
    """What stands beside a word that starts or ends in c: a space, or anything for letters of scripts written without spaces."""
    return "" if _SPACELESS.match(c) else " "


def pieces(n: int, errors: int) -> list[tuple[int, int]]:
    """errors + 1 spans of even length that make up n characters."""
    cuts = [i * n // (errors + 1) for i in range(errors + 2)]
    return list(zip(cuts, cuts[1:]))


def myers(masks: dict[str, int], m: int, text: str, most: int) -> tuple[int, int] | None:
    """Smallest edit distance, at most `most`, of the pattern to a part of text, and the first end where it is reached."""
    ones, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = ones, 0, m, None
    get = masks.get
    for at, c in enumerate(text, 1):
        eq = get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | ~(xh | plus) & ones
        mh = plus & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & ones
        mh = mh << 1 & ones
        plus = mh | ~(xv | ph) & ones
        minus = ph & xv
        if score <= most and (best is None or score < best[0]):
            best = (score, at)
    return best


class Matcher:
    """Finds the items of one block in normalised texts."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float):
        import ahocorasick

        self.items, where = [], defaultdict(list)
        for item_id, text in items:
            if not text:
                continue
            whole, errors = edge(text[0]) + text + edge(text[-1]), int(len(text) * error_rate)
            masks: dict[str, int] = defaultdict(int)
            for i, c in enumerate(whole):
                masks[c] |= 1 << i
            for a, b in pieces(len(whole), errors):
                where[whole[a:b]].append((len(self.items), b))
            self.items.append((item_id, len(whole), errors, dict(masks), len(edge(text[-1]))))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, places)
        if where:
            self.automaton.make_automaton()

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, errors, allowed, end) of the closest occurrence of each item that occurs; the first end at a tie."""
        if not self.items:
            return []
        windows, out = defaultdict(list), {}
        edged = f" {text} "
        for last, places in self.automaton.iter(edged):
            for item, end in places:
                _, n, errors, *_ = self.items[item]
                start = last + 1 - end
                windows[item].append((max(0, start - errors), min(len(edged), start + n + errors)))
        for item, spans in windows.items():
            item_id, n, errors, masks, after = self.items[item]
            spans.sort()
            merged = [list(spans[0])]
            for a, b in spans[1:]:
                if a <= merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            for a, b in merged:
                found = myers(masks, n, edged[a:b], errors)
                if found:
                    place = max(0, min(len(text), a + found[1] - 1 - after))  # without the edges of the text and of the item
                    if item_id not in out or (found[0], place) < (out[item_id][0], out[item_id][2]):
                        out[item_id] = (found[0], errors, place)
        return [(item_id, *x) for item_id, x in sorted(out.items())]


def _find(items: list[tuple[int, str]], error_rate: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(items, error_rate)
        for batch in batches:
            found = [(d, *m) for d, t in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True) if t for m in matcher.matches(normal(t))]
            if found:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=["doc_id", "item_id", "errors", "allowed", "end"])
            release_memory()

    return run


def blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of at most block_chars characters (an item over that is a block of its own); one is held at a time."""
    held, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL AND item_id IS NOT NULL")
    for item_id, text in rows.toLocalIterator():
        text = normal(text)
        if held and size + len(text) > block_chars:
            yield held
            held, size = [], 0
        held.append((item_id, text))
        size += len(text)
    if held:
        yield held


def find_leaks(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """MATCHES: each document and test item that occurs in it with at most `allowed` errors; `end` is the place in the normalised text where the
    item's last word ends (one before it, where the error is that word's missing edge).

    Documents are read once for each block of items; only a block, of bounded size, is sent to the executors. Items and documents with a
    null id or text, and items without a word, match nothing. An item of n characters may have int(n * error_rate) errors, whatever its length; the edges of
    its first and last word count as characters, but not in scripts without spaces. Rows that repeat an id: a document repeats its matches, an
    item counts by its closest row. Whole texts of any length are searched; other columns are not read.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    parts, last = [], None
    for items in blocks(benchmark, block_chars):
        if last is not None:
            parts.append(materialise(last, "leaks"))
        last = rows.mapInArrow(_find(items, error_rate), MATCHES)
    if last is None:
        return rows.limit(0).mapInArrow(_find([], error_rate), MATCHES)
    for part in parts:
        last = last.unionByName(part)
    if parts:  # an item id may be in two blocks
        last = last.groupBy("doc_id", "item_id").agg(F.min_by(F.struct("errors", "allowed", "end"), F.struct("errors", "end")).alias("m")).select("doc_id", "item_id", "m.*")
    return last


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs, with all their columns, in which no test item occurs. Rows with a null id or text stay."""
    bad = find_leaks(docs, benchmark, **options).select(F.col("doc_id").alias("_leaky")).distinct()
    return docs.join(bad, docs["doc_id"] == bad["_leaky"], "left_anti")
