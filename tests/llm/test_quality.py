"""The quality classifier's statistics and fit, held against plain loops."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstone.llm import quality

BLANK = b" \t\n\x0b\x0c\r"


def plain_statistics(text):
    """FEATURES of one text, byte by byte."""
    if not text:
        return [0.0] * len(quality.FEATURES)
    n, words = len(text), [w for w in re.split(rb"[ \t\n\x0b\x0c\r]+", text) if w]
    share = lambda *ranges: sum(any(a <= b <= z for a, z in ranges) for b in text) / n
    known = lambda b: b >= 128 or b in BLANK or b in b"!|.," or chr(b).isalnum()
    per_word = lambda x: x / max(len(words), 1)
    sizes = [len(w) for w in words] or [0]
    mean = sum(sizes) / len(sizes)
    pairs = list(zip(words, words[1:]))
    lines = [x for x in re.findall(rb"[^\n]*\n|[^\n]+$", text) if x != b"\n"]  # a line counts with its end, so that a last one without differs
    return [
        math.log1p(n), math.log1p(len(words)), mean, math.sqrt(max(0, sum(s * s for s in sizes) / len(sizes) - mean**2)), share((65, 90)), share((48, 57)), sum(not known(b) for b in text) / n,
        *(per_word(text.count(c)) for c in (b"!", b"|", b".", b",")), per_word(len(lines)), share((128, 255)), per_word(len(set(words))),
        per_word(max(Counter(words).values(), default=0)), len(set(pairs)) / max(len(words) - 1, 1), 1 - len(set(lines)) / max(len(lines), 1), len(words) / max(len(lines), 1),
        per_word(sum(65 <= w[0] <= 90 for w in words)), per_word(sum(not known(w[-1]) for w in words)),
    ]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("aAz09.,!|-\n\n  \tåÄ☃(", max_size=60), min_size=1, max_size=6))
def test_statistics_of_small_texts(texts):
    texts = [t.encode() for t in texts]
    assert np.allclose(quality.statistics(texts), [plain_statistics(t) for t in texts])


def test_statistics_of_a_corpus(rows):
    texts = [(t or "").encode() for _, t in rows]
    assert np.allclose(quality.statistics(texts), [plain_statistics(t) for t in texts])


def plain_fit(x, y, trees, depth, rate, bins, ridge, least):
    """The same boosting without histograms: each split is tried on the rows themselves."""
    cuts = [sorted({float(np.quantile(x[:, f], q, method="lower")) for q in np.linspace(0, 1, bins + 1)[1:-1]}) for f in range(x.shape[1])]
    mean = min(max(y.mean(), 1e-3), 1 - 1e-3)
    base = math.log(mean / (1 - mean))
    margin, out = [base] * len(x), []
    for _ in range(trees):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        g, h = [a - b for a, b in zip(p, y)], [max(a * (1 - a), 1e-6) for a in p]
        total = lambda v, rows: sum(v[i] for i in rows)
        worth = lambda rows: total(g, rows) ** 2 / (total(h, rows) + ridge)
        leaves = [(list(range(len(x))), [])]
        for _ in range(depth):
            grown = []
            for rows, path in leaves:
                best = (1e-9, None)
                for f, points in enumerate(cuts):
                    for c in points:
                        left, right = [i for i in rows if x[i, f] <= c], [i for i in rows if x[i, f] > c]
                        if min(len(left), len(right)) >= least and (gain := worth(left) + worth(right) - worth(rows)) > best[0] + 1e-12:
                            best = gain, (f, c)
                f, c = best[1] or (0, math.inf)
                grown += [([i for i in rows if x[i, f] <= c], [*path, (f, c)]), ([i for i in rows if x[i, f] > c], [*path, (f, c)])]
            leaves = grown
        values = [-rate * total(g, rows) / (total(h, rows) + ridge) for rows, _ in leaves]
        for (rows, _), v in zip(leaves, values):
            for i in rows:
                margin[i] += v
        out.append(([path for _, path in leaves], values))
    return base, out


@pytest.mark.parametrize("seed", [1, 2])
def test_fit_without_histograms(seed):
    r = np.random.default_rng(seed)
    x = np.stack([r.normal(size=160), r.integers(0, 4, 160), r.normal(size=160)], axis=1)
    y = (x[:, 0] + (x[:, 1] > 1) + 0.3 * r.normal(size=160) > 0.5).astype(float)
    model = quality.fit(x, y, trees=5, depth=2, rate=0.3, bins=8, ridge=1.0, least=6)
    base, trees = plain_fit(x, y, 5, 2, 0.3, 8, 1.0, 6)
    assert model.base == pytest.approx(base)
    for t, (paths, values) in enumerate(trees):
        for leaf, path in enumerate(paths):
            node = 0
            for level, (f, c) in enumerate(path):
                assert (model.feature[t, node], model.threshold[t, node]) == (f, c)
                node = 2 * node + 1 + (leaf >> (len(path) - 1 - level) & 1)
        assert np.allclose(model.leaf[t], values)
