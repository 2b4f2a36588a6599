"""A quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from one numpy pass over the bytes of many documents. Trees are complete, of fixed depth, kept as flat
arrays (feature, threshold, leaf value), and scored level by level for all rows at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm import text as tx
from quillstone.llm.common import bound_batches, in_parts

FEATURES = (
    "log_bytes", "log_words", "mean_word", "sd_word", "upper", "digit", "symbol", "bang", "pipe", "stop", "comma", "lines", "beyond_ascii",
    "distinct_words", "top_word", "distinct_pairs", "repeated_lines", "mean_line", "capital_words", "symbol_words",
)

#: Rows of labels to learn from at most: the fit runs on the driver, on this many rows of len(FEATURES) numbers.
MOST_ROWS = 20_000


def _per_doc(mask: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _distinct(doc: np.ndarray, keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, and rows of the most frequent key, of each document."""
    order = np.lexsort((keys, doc))
    d, k = doc[order], keys[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (k[1:] != k[:-1])
    at = np.flatnonzero(new)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, d[at], np.diff(np.append(at, len(d))))
    return np.bincount(d[at], minlength=n), top


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row of FEATURES for each text; an empty text has zeros."""
    n = len(texts)
    buf, bounds = tx.joined(texts)
    size = np.diff(bounds) - 1
    count = lambda mask: _per_doc(mask, bounds).astype(float)
    upper, digit, high = (buf >= 65) & (buf <= 90), (buf >= 48) & (buf <= 57), buf >= 128
    lower = (buf >= 97) & (buf <= 122)
    bang, pipe, stop, comma, line = buf == 33, buf == 124, buf == 46, buf == 44, buf == 10
    symbol = ~(upper | lower | digit | high | bang | pipe | stop | comma | tx.blanks(buf))
    starts, ends = tx.word_spans(buf)
    doc = np.searchsorted(bounds, starts, "right") - 1
    words = np.bincount(doc, minlength=n).astype(float)
    length = (ends - starts).astype(float)
    mean = np.bincount(doc, length, n) / np.maximum(words, 1)
    spread = np.sqrt(np.maximum(0, np.bincount(doc, length**2, n) / np.maximum(words, 1) - mean**2))
    h = tx.span_hashes(buf, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    kinds, top = _distinct(doc, h, n)
    same = doc[1:] == doc[:-1]
    pair_doc, pairs = doc[1:][same], tx.ngram_hashes(h, 2)[same] if len(h) > 1 else np.zeros(0, np.uint64)
    pair_kinds, _ = _distinct(pair_doc, pairs, n)
    cut = np.flatnonzero(line | (np.arange(len(buf)) == 0))
    cut = np.union1d(np.where(buf[cut] == 10, cut + 1, cut), bounds[:-1])
    cut = cut[cut < len(buf)] if len(buf) else cut[:0]
    till = np.append(cut[1:], len(buf)) if len(cut) else cut
    line_doc = np.searchsorted(bounds, cut, "right") - 1
    full = till - cut > 1
    lines = np.bincount(line_doc[full], minlength=n).astype(float)
    line_kinds, _ = _distinct(line_doc[full], tx.span_hashes(buf, cut[full], till[full]) if full.any() else np.zeros(0, np.uint64), n)
    some = np.maximum(size, 1).astype(float)
    per_word = np.maximum(words, 1)
    odd = np.bincount(doc, symbol[ends - 1], n) if len(ends) else np.zeros(n)
    out = np.stack([
        np.log1p(size), np.log1p(words), mean, spread, count(upper) / some, count(digit) / some, count(symbol) / some, count(bang) / per_word,
        count(pipe) / per_word, count(stop) / per_word, count(comma) / per_word, lines / per_word, count(high) / some, kinds / per_word,
        top / per_word, pair_kinds / np.maximum(words - 1, 1), 1 - line_kinds / np.maximum(lines, 1), words / np.maximum(lines, 1),
        (np.bincount(doc, upper[starts], n) if len(starts) else np.zeros(n)) / per_word, odd / per_word,
    ], axis=1)
    out[size == 0] = 0
    return out


@dataclass
class Trees:
    """feature, threshold: (trees, 2**depth - 1); leaf: (trees, 2**depth); a row goes right where its value is above the threshold."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        depth = self.leaf.shape[1].bit_length() - 1
        rows, out = np.arange(len(x)), np.full(len(x), self.base)
        for f, t, v in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += v[node - (len(v) - 1)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: int = 20) -> Trees:
    """Logistic boosting on binned columns; a node's split maximises the usual gain, found from its histograms of gradients.

    Labels of one kind, or none, give a constant score.
    """
    n, width = x.shape
    mean = float(np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3))
    base = float(np.log(mean / (1 - mean)))
    inner, leaves = 2**depth - 1, 2**depth
    feature, threshold, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    if n == 0 or y.min() == y.max():
        return Trees(feature, threshold, leaf, base)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)  # bin b: above b cuts
    flat = binned + np.arange(width) * bins
    margin = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            at = ((node - first)[:, None] * (width * bins) + flat).ravel()
            shape = (many, width, bins)
            hist = [np.cumsum(np.bincount(at, np.repeat(v, width), many * width * bins).reshape(shape), axis=2) for v in (g, h, np.ones(n))]
            (gl, hl, nl), (ga, ha, na) = hist, [v[:, :1, -1:] for v in hist]
            gain = gl**2 / (hl + ridge) + (ga - gl) ** 2 / (ha - hl + ridge) - ga**2 / (ha + ridge)
            gain = np.where((nl >= least) & (na - nl >= least), gain, 0)
            for f, c in enumerate(cuts):
                gain[:, f, len(c) :] = 0
            best = gain.reshape(many, -1).argmax(1)
            worth = gain.reshape(many, -1)[np.arange(many), best] > 1e-9
            f, b = best // bins, best % bins
            for i in np.flatnonzero(worth):
                feature[t, first + i], threshold[t, first + i] = f[i], cuts[f[i]][b[i]]
            here = node - first
            node = 2 * node + 1 + (worth[here] & (binned[np.arange(n), f[here]] > b[here]))
        at = node - inner
        leaf[t] = -rate * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + ridge)
        margin += leaf[t][at]
    return Trees(feature, threshold, leaf, base)


def _score(model: Trees) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts, part in in_parts(batches):
            rest = [part.column(i) for i in range(part.num_columns)]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(model.score(statistics(texts)))], names=[*part.schema.names, "score"])

    return run


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, texts, part in in_parts(batches):
        x = statistics(texts)
        yield pa.RecordBatch.from_arrays([part["doc_id"], part["quality"], pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "quality", "x"])


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 1 modulo 3: labels of these rows are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, **options) -> Trees:
    """Trees fitted on the labelled documents that aren't held out: all of them, or the most_rows smallest by a hash of the id.

    At most most_rows labels are broadcast and as many rows of statistics reach the driver, one for each label however often its document is
    repeated (the smallest one of several texts); nothing else does. Labels with a null id or quality are left out, a null text counts as empty; an id
    that is labelled twice is learned with each different label. Without labelled documents, or with labels of one kind, the score is a constant.
    """
    bound_batches(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("double").alias("quality"))
    known = known.where(F.col("quality").isNotNull() & F.col("_id").isNotNull() & ~held_out(F.col("_id")))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(most_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "quality")
    got = found.mapInArrow(_measure, "doc_id long, quality double, x array<double>").groupBy("doc_id", "quality").agg(F.min("x").alias("x")).toArrow()
    x = np.array(got["x"].to_pylist(), float).reshape(-1, len(FEATURES))
    y = np.array(got["quality"].to_pylist(), float)
    order = np.lexsort((*x.T, y))  # the fit doesn't depend on the order in which rows arrive
    return fit(x[order], y[order], **options)


def score_documents(docs: DataFrame, model: Trees) -> DataFrame:
    """doc_id, held_out, score, predicted for each document; whole texts, no shuffle.

    A null text counts as empty, an empty text has the score of zero statistics; a null doc_id stays null. Repeated rows get equal
    scores; other columns of docs are not read.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(_score(model), "doc_id long, text string, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Trees) -> DataFrame:
    """The rows of docs, with all their columns, that the model doesn't reject: a score of 0.5 or more.

    A null text counts as empty and goes by the score of zero statistics. Ids aren't looked at, so rows with a null one, and repeated rows, are kept or rejected
    each by its text. An empty table stays empty.
    """
    bound_batches(docs.sparkSession)
    kind = docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts, part in in_parts(batches):
            yield part.filter(pa.array(model.score(statistics(texts)) >= 0.5))

    return kind.mapInArrow(run, kind.schema)
