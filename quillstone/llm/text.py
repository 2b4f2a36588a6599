"""Vectorised numpy passes over the UTF-8 bytes of many texts at once."""

from __future__ import annotations

import numpy as np

#: Odd multiplier of the rolling sums, and the two multipliers of the 64-bit mixer (fixed values of a published finalizer).
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """BASE ** 0 ... BASE ** (n - 1) modulo 2**64."""
    global _powers
    if len(_powers) < n:
        p = np.full(max(n, 1024), BASE, np.uint64)
        p[0] = 1
        _powers = np.multiply.accumulate(p)
    return _powers[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * MIX1
    h ^= h >> np.uint64(27)
    h *= MIX2
    return h ^ (h >> np.uint64(31))


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One buffer with a space after each text, and the texts' bounds: text i is buffer[bounds[i] : bounds[i + 1] - 1]."""
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=bounds[1:])
    return np.frombuffer(b" ".join([*texts, b""]), np.uint8), bounds


def lower_az(buffer: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all else unchanged."""
    return np.where((buffer >= 65) & (buffer <= 90), buffer | 32, buffer)


def blanks(buffer: np.ndarray) -> np.ndarray:
    return (buffer == 32) | ((buffer >= 9) & (buffer <= 13))


def word_spans(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs without space, tab, line feed, vertical tab, form feed and carriage return."""
    inside = np.zeros(len(buffer) + 2, np.int8)
    inside[1:-1] = ~blanks(buffer)
    edges = np.diff(inside)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def span_hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, slab: int = 1 << 20) -> np.ndarray:
    """64-bit hashes of buffer[start:end] for spans that aren't empty and whose starts ascend.

    A span is cut into lanes of eight bytes; each lane is mixed with its place before the lanes are added, so that no rearrangement of a
    span's bytes cancels out, as it does in sums of powers modulo 2**64.
    """
    out = np.empty(len(starts), np.uint64)
    lens = ends - starts
    lanes = np.cumsum(-(-lens // 8))
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(lanes, (lanes[at - 1] if at else 0) + slab // 8, "right")))
        s, e = starts[at:to], ends[at:to]
        first, n = s[0], -(-lens[at:to] // 8)
        local = np.append(buffer[first : e.max()], np.zeros(8, np.uint8))
        eights = np.lib.stride_tricks.as_strided(local, (len(local) - 7, 8), (1, 1))
        ahead = np.cumsum(n) - n
        place = np.arange(int(n.sum())) - np.repeat(ahead, n)
        lane = np.repeat(s - first, n) + 8 * place
        w = eights[lane].view("<u8").ravel()
        short = 8 - (np.repeat(e - first, n) - lane)
        w <<= (8 * np.maximum(short, 0)).astype(np.uint64)  # bytes beyond the span
        place = place.astype(np.uint64)
        w = mix(w + (place + np.uint64(1)) * BASE)
        if len(w) > len(s):  # the first lane's factor is one
            w = np.add.reduceat(w * (mix(place) | np.uint64(1)), ahead)
        out[at:to] = w
        at = to
    return mix(out + lens.astype(np.uint64))


def same_bytes(buffer: np.ndarray, a: np.ndarray, b: np.ndarray, lens: np.ndarray) -> bool:
    """Whether buffer[a : a + len] and buffer[b : b + len] agree for all spans."""
    other = a != b
    at = np.flatnonzero(other)
    for i in range(0, len(at), 1 << 16):
        k = at[i : i + (1 << 16)]
        if not np.array_equal(buffer[gather(a[k], lens[k])], buffer[gather(b[k], lens[k])]):
            return False
    return True


def gather(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... start + len - 1 of each span, one span after another."""
    lens = np.asarray(lens, np.int64)
    ahead = np.cumsum(lens) - lens
    return np.arange(int(lens.sum())) + np.repeat(starts - ahead, lens)


def ngram_hashes(tokens: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of n consecutive 64-bit tokens, one for each start."""
    count = max(0, len(tokens) - n + 1)
    h = np.zeros(count, np.uint64)
    for i in range(n):
        h = (h ^ (h >> np.uint64(29))) * BASE + tokens[i : i + count]
    return mix(h)
